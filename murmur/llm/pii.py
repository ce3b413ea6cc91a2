"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs,
digits, schemes, identifier cues and street words. From each anchor a
deterministic local parser expands to the left and right and validates the
boundaries it found. Per kind, spans are leftmost and do not overlap; a
candidate that fails its validation is dropped and not retried.

==========  ====================================================================
email       local part, at-sign, at least two dot-joined labels
ip          four dot-joined numbers, each at most 255
card        13 to 19 digits with single blanks or hyphens between, Luhn sum 0
phone       plus sign, digit, digits and `` ().-``, 9 to 15 digits in all
account     IBAN after a cue, or compact without one where its country's length
            and the check digits hold; 7 to 17 digits after an account's cue
login       scheme://user@host: an address that carries user data
bank        after their cues: sort codes, routing numbers (checksum), BICs (country)
id          after their cues: social security, national insurance, passport, VAT,
            tax and employer numbers by format, check digit or both
birth       a calendar date after a cue of birth
address     house number, one to four capitalised words and a street word, or a
            German street name and its number; with the place and postcode next to it
==========  ====================================================================

Cues are whole words in lower case, upper case or with capitals. A label
between cue and number (``no.``, ``number``, ``is``, ``:``) is passed over.

Positions are code points, ends exclusive. Input cases: null is empty text;
empty texts have no spans; texts are taken whole, however long (work is linear
in their length); rows with equal or null ids stay rows of their own; an empty
table gives no rows; further input columns are kept by :func:`redact_pii` and
ignored by :func:`pii_spans`, whatever their names."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import by_value, narrow, parts, texts

by_value(__name__)

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("account", "login", "bank", "id", "birth", "address")
DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIAL = re.compile(r"[ ().0-9-]+")
_IBAN = re.compile(r"(?:[\s-]?(?i:number|nummer|no|nr)\b)?[\s:#.-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_IBAN_SIZE = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 "
    "FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 "
    "LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 "
    "RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}
_COMPACT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]+")
_ENDS = re.compile(r"[A-Z0-9](?![A-Z0-9])")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]*[A-Za-z0-9]")


# --- cues ----------------------------------------------------------------------------
#: What may stand between a cue and its number, and where a number must end.
_LABEL = r"(?i:nummer|number)?(?:[\s:#=.-]|(?i:\b(?:numbers?|nummer|no|nr|num|code|is|ist|id)\b)){1,8}"
_STOP = r"(?![0-9A-Za-z]|[-/.][0-9])"
#: Countries of a BIC beside those that have IBANs.
_BIC_MORE = frozenset("AR AU CA CL CN CO HK ID IN JP KE KR MX MY NG NZ PE PH SG TH TW US VN ZA".split())


def _routing_ok(s: str) -> bool:
    return sum(int(d) * (3, 7, 1)[i % 3] for i, d in enumerate(s)) % 10 == 0 and int(s) > 0


def _tax_ok(s: str) -> bool:
    """German tax number: ISO 7064 mod 11, 10."""
    rest = 10
    for d in s[:10]:
        rest = ((int(d) + rest) % 10 or 10) * 2 % 11
    return s[0] != "0" and (11 - rest) % 10 == int(s[10])


def _ssn_ok(s: str) -> bool:
    area, group, serial = s[:3], s[4:6], s[7:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _date_ok(s: str) -> bool:
    n = [int(x) for x in re.findall("[0-9]+", s)]
    y, m, d = (n[0], n[1], n[2]) if n[0] > 31 else (n[2], n[1], n[0])
    return 1880 <= y <= 2100 and 1 <= min(m, d) and min(m, d) <= 12 and max(m, d) <= 31


def _any(_: str) -> bool:
    return True


#: name: (kind, cues, format, rule)
_PARSERS = {
    "account": ("account", "account acct a/c konto compte cuenta", r"[0-9]{7,17}", _any),
    "sort": ("bank", "sort_code sortcode", r"[0-9]{2}([ -]?)[0-9]{2}\2[0-9]{2}", _any),
    "routing": ("bank", "routing aba", r"[0-9]{9}", _routing_ok),
    "bic": ("bank", "bic swift", r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?",
            lambda s: s[4:6] in _IBAN_SIZE or s[4:6] in _BIC_MORE),
    "ssn": ("id", "ssn social_security", r"[0-9]{3}([ -])[0-9]{2}\2[0-9]{4}", _ssn_ok),
    "nino": ("id", "nino national_insurance", r"[A-CEGHJ-PR-TW-Z]{2}(?: ?[0-9]{2}){3} ?[A-D]", _any),
    "passport": ("id", "passport reisepass passeport pasaporte", r"[A-Z]{1,2}[0-9]{6,8}|[0-9]{9}|[0-9]{2}[A-Z]{2}[0-9]{5}", _any),
    "vat": ("id", "vat USt-IdNr USt-ID", r"[A-Z]{2} ?[0-9]{8,12}", lambda s: s[:2] in _IBAN_SIZE),
    "tax": ("id", "tax Steuer-ID steuernummer IdNr tin", r"[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}",
            lambda s: _tax_ok(s.replace(" ", ""))),
    "ein": ("id", "ein employer", r"[0-9]{2}-[0-9]{7}", _any),
    "birth": ("birth", "date_of_birth birth_date dob born geboren geburtsdatum birthday",
              r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2(?:19|20)[0-9]{2}", _date_ok),
}
_PATTERN = {name: re.compile(f"{_LABEL}(?:(?i:on|am) )?({form}){_STOP}") for name, (_, _, form, _) in _PARSERS.items()}
_WORD = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]+"
_STREETS = "Street Avenue Road Lane Drive Boulevard Terrace Square Crescent Highway St. Ave. Rd. Blvd."
#: To the left of a street word, read from its end; to the right of it.
_HOUSE = re.compile(rf"(?:^|(?<=[\s,;:(]))[0-9]{{1,5}}[A-Za-z]? (?:{_WORD}\.? |[0-9]{{1,3}}(?:st|nd|rd|th) ){{1,4}}$")
_PLACE = re.compile(rf"(?:,? (?:(?:Apt|Suite|Unit|Flat)\.? [0-9A-Z]{{1,5}}))?(?:, {_WORD}(?: {_WORD}){{0,2}})?"
                    r"(?:,? [A-Z]{2} [0-9]{5}(?:-[0-9]{4})?|,? [A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2})(?![0-9A-Za-z])")
_STRASSE = re.compile(r"[A-ZÄÖÜ][a-zäöüß-]{1,30}$")
_NUMMER = re.compile(rf" [0-9]{{1,4}}(?: ?[a-z])?(?![0-9A-Za-z.])(?:, ?[0-9]{{5}} {_WORD}(?: {_WORD})?)?")
HOUSE_CHARS = 160


def anchors():
    """The automaton; its values name the parser to start and the anchor's length."""
    import ahocorasick
    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"),
                       ("IBAN", "cue"), ("iban", "cue"), ("Iban", "cue")):
        a.add_word(word, (kind, len(word)))
    for name, (_, cues, _, _) in _PARSERS.items():
        for cue in cues.replace("_", "\0").split(" "):
            cue = cue.replace("\0", " ")
            for form in {cue, cue.lower(), cue.upper(), cue.capitalize(), cue.title()}:
                a.add_word(form, (name, len(form)))
    for word in _STREETS.split():
        a.add_word(word, ("street", len(word)))
    for word in ("straße", "strasse"):
        a.add_word(word, ("strasse", len(word)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(text: str, start: int, end: int) -> int | None:
    """Where the account number that starts at ``start`` ends, at most at
    ``end``: its country's length goes first, then the token ends from the last
    on (for a known country only the last) until the check digits hold."""
    ends = [m.end() for m in _ENDS.finditer(text, start, min(len(text), end + 1)) if m.end() <= end]
    # the match may stop inside a token
    if ends and ends[-1] == end and text[end:end + 1].isascii() and (text[end:end + 1].isupper() or text[end:end + 1].isdigit()):
        ends.pop()
    ends.reverse()
    size = _IBAN_SIZE.get(text[start:start + 2])
    own = [e for e in ends if len(text[start:e].replace(" ", "")) == size]
    return next((e for e in own + (ends[:1] if size else ends) if _iban_ok(text[start:e])), None)


def find_spans(text: str, automaton) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as in ``KINDS``, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)   # where the search of each kind goes on

    def hit(kind: str, start: int, end: int, good: bool) -> None:
        done[kind] = end
        if good:
            found[kind].append((start, end))

    for last, (anchor, size) in automaton.iter(text):
        if anchor == "digit":
            # the first digit of a run, or the first one after a match
            if last >= done["ip"] and (last == done["ip"] or last == 0 or text[last - 1] not in DIGITS):
                if m := _QUAD.match(text, last):
                    tight = [p.lstrip("0") or "0" for p in m.group().split(".")]
                    hit("ip", last, m.end(), all(len(p) <= 3 and int(p) <= 255 for p in tight))
            if last >= done["card"] and (m := _CHAIN.match(text, last)):
                digits = m.group().replace(" ", "").replace("-", "")
                hit("card", last, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
            if last >= 2 and last - 2 >= done["account"] and text[last - 2:last] in _IBAN_SIZE and not text[last - 3:last - 2].isalnum():
                end = last - 2 + _IBAN_SIZE[text[last - 2:last]]
                if _COMPACT.fullmatch(text, last - 2, end) and not text[end:end + 1].isalnum() and _iban_ok(text[last - 2:end]):
                    hit("account", last - 2, end, True)
        elif anchor == "at":
            start = last
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                hit("email", start, m.end(), True)
        elif anchor == "plus":
            if last >= done["phone"] and text[last + 1:last + 2] in DIGITS and (m := _DIAL.match(text, last + 2)):
                end = m.end()
                while end > last + 3 and text[end - 1] not in DIGITS:
                    end -= 1
                if end > last + 3:
                    n = sum(c in DIGITS for c in text[last:end])
                    hit("phone", last, end, 9 <= n <= 15)
        elif anchor == "cue":
            if last >= done["account"] and (m := _IBAN.match(text, last + 1)):
                # what fails is no account: a cue inside it still counts
                if end := _iban_end(text, m.start(1), m.end(1)):
                    hit("account", m.start(1), end, True)
        elif anchor in _PARSERS:
            kind, _, _, rule = _PARSERS[anchor]
            if last >= done[kind] and not text[max(0, last - size):last - size + 1].isalnum():
                if (m := _PATTERN[anchor].match(text, last + 1)) and rule(m.group(1)):
                    hit(kind, m.start(1), m.end(1), True)
        elif anchor == "street":
            if last >= done["address"] and not text[last + 1:last + 2].isalnum():
                first = last + 1 - size
                if m := _HOUSE.search(text[max(done["address"], first - HOUSE_CHARS):first]):
                    start = max(done["address"], first - HOUSE_CHARS) + m.start()
                    right = _PLACE.match(text, last + 1)
                    hit("address", start, right.end() if right else last + 1, True)
        elif anchor == "strasse":
            if last >= done["address"] and (m := _NUMMER.match(text, last + 1)):
                first = last + 1 - size
                if left := _STRASSE.search(text[max(done["address"], first - HOUSE_CHARS):first]):
                    hit("address", first - len(left.group()), m.end(), True)
        elif anchor == "scheme" and last >= done["login"] and (m := _LOGIN.match(text, last + 1)):
            start = last - 2
            while start > done["login"] and text[start - 1].isascii() and text[start - 1].isalnum():
                start -= 1
            hit("login", start, m.end(), start < last - 2)
    return [(k, s, e) for k in KINDS for s, e in found[k]]


_SPAN = "array<struct<kind:string,start:long,end:long>>"
_SPAN_PA = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row per input row, spans by kind, then start."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        automaton = anchors()
        for batch in batches:
            for some in parts(batch, 1024):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, automaton)]
                         for t in texts(some, "text")]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(spans, _SPAN_PA)],
                                                 names=["doc_id", "spans"])

    own = narrow(docs, doc_id=id_col, text=text_col)
    return own.mapInArrow(run, f"doc_id {kind.simpleString()}, spans {_SPAN}")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digest(spans: DataFrame) -> DataFrame:
    """Counts, the digest of the base kinds and all spans as text."""
    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return spans.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_text(of(*BASE_KINDS)), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def mask_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; spans that
    overlap become one, named after the first."""
    out, at = [], 0
    merged: list[list] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The same rows and columns with personal data in ``text_col`` masked;
    ``chars_col`` is set to the new length. Null texts stay null."""
    names, schema = docs.columns, docs.schema

    def run(batches):
        automaton = anchors()
        for batch in batches:
            for some in parts(batch, 1024):
                old = some.column(names.index(text_col)).to_pylist()
                new = [t if t is None else mask_text(t, s) if (s := find_spans(t, automaton)) else t for t in old]
                cols = list(some.columns)
                cols[names.index(text_col)] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(
                    [pa.field(f.name, c.type) for f, c in zip(some.schema, cols)]))

    out = docs.mapInArrow(run, schema)
    if chars_col is not None:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(
            F.length(text_col).cast(schema[chars_col].dataType)))
    return out
