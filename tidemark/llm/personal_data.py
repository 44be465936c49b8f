"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Everything is a projection over single rows: nothing is shuffled, and no Python runs. Each expression passes once over the text
for its matches and, where there are any, once more for the pieces between them; lengths of pieces and matches add up to places. The expressions take runs of
characters whole (possessively) and only from their first character on, so that a long text costs time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.once import once

# Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone", "iban")
#: What proposes. The base patterns of email, ip and card, and that of phones behind its first bar, in forms without backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]|\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3,5}[ .-][0-9]{3,4}[ .-][0-9]{3,4}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
}
#: A card's sixteen digits inside a longer run of numbers.
INSIDE = r"^(.*?(?:^|[ -]))([0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{16})(?:[ -]|$)"
# Percent for a match as such, a checksum that holds, a word that speaks for its kind, one that speaks against it; spans beyond the
# base patterns are taken from ACCEPTED on.
PRIOR = {"email": 60, "ip": 50, "card": 30, "phone": 50, "iban": 30, "inner_card": 10, "national": 30}
CHECKSUM, FOR, AGAINST, ACCEPTED = 40, 30, -30, 60
# Characters in which such words are looked for, up to the next match of the pattern at most.
BEFORE, AFTER = 40, 20
# Words that speak for a kind, and words that speak against every kind.
WORDS = {
    "email": "mail email contact write address",
    "ip": "ip address host server login client",
    "card": "card credit debit visa mastercard amex payment karte kreditkarte carte tarjeta",
    "phone": "phone telephone tel mobile cell call fax telefon handy telefono movil portable",
    "iban": "iban account bank konto compte cuenta",
}
AGAINST_WORDS = "isbn version invoice order tracking serial"
# Characters of an IBAN by country.
IBAN_LENGTHS = dict((x[:2], int(x[2:])) for x in """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22
GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31
MU30 NI28 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20
""".split())
BLOCK = 256

SPAN = "struct<kind:string,start:bigint,end:bigint,found:string,score:int,base:boolean>"


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and ``spans``, an array of (kind, start, end, found, score, base) by kind, then start.

    Places count code points from 0, ends are exclusive. ``base`` spans are the leftmost matches of the base patterns, those of a kind not
    overlapping, that pass: parts of an ip of at most 255, cards of 16 to 19 digits by Luhn, phones of 8 to 15 digits; all of them stay, whatever their score. Others are
    added from a score of ``ACCEPTED`` on: cards of 13 to 15 digits, or of sixteen inside a longer run of numbers, by Luhn and a word nearby; national phone numbers
    by a word nearby; IBANs of their country's length by the remainder of 97. Spans of different kinds may overlap.
    A null text has no spans. Rows are judged one by one: repeated rows and null ids stay as they are, an empty table gives none, and other columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    nothing = F.array().cast("array<string>")
    rows = docs.select("doc_id", text.alias("text"))

    def all_of(kind: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(F.contains("text", F.lit("@")), found).otherwise(nothing) if kind == "email" else found

    each = lambda make: [make(k).alias(f"{make.__name__}_{k}") for k in KINDS]

    def found(k):
        return all_of(k)

    def between(k):
        return F.when(F.size(f"found_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(nothing)

    def sizes(k):
        return F.zip_with(f"found_{k}", F.slice(f"between_{k}", 1, F.greatest(F.size(f"between_{k}") - 1, F.lit(0))),
                          lambda f, b: (F.length(f) + F.length(b)).cast("long"))

    def ends(k):
        return _running(F.col(f"sizes_{k}"))

    def spans(k):
        zipped = F.arrays_zip(F.col(f"found_{k}").alias("found"), F.col(f"ends_{k}").alias("end"), F.col(f"between_{k}").alias("before"),
                              F.slice(f"between_{k}", 2, F.greatest(F.size(f"between_{k}") - 1, F.lit(0))).alias("after"))
        zipped = F.slice(zipped, 1, F.size(f"found_{k}"))
        return F.array_compact(F.transform(zipped, lambda x: _SPANS[k](x["found"], x["end"] - F.length(x["found"]), x["end"], x["before"], x["after"])))

    rows = once(rows, *each(found))
    rows = once(rows, *each(between), keep=["doc_id", *_names("found")])
    rows = once(rows, *each(sizes), keep=["doc_id", *_names("found"), *_names("between")])
    rows = once(rows, *each(ends), keep=["doc_id", *_names("found"), *_names("between")])
    return rows.select("doc_id", F.concat(*[spans(k).cast(f"array<{SPAN}>") for k in KINDS]).alias("spans"))


def _names(what: str) -> list[str]:
    return [f"{what}_{k}" for k in KINDS]


def _running(values: Column) -> Column:
    """Running sums of an array, by blocks, so that building them costs time in proportion."""
    def sums(block: Column) -> Column:
        upto = F.aggregate(block, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
        return F.slice(upto, 2, F.greatest(F.size(upto) - 1, F.lit(0)))

    n_blocks = F.ceil(F.size(values) / BLOCK)
    cut = F.transform(F.sequence(F.lit(1).cast("long"), n_blocks), lambda b: F.slice(values, ((b - 1) * BLOCK + 1).cast("int"), BLOCK))
    inner = F.transform(cut, sums)
    before = F.transform(cut, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, v: acc + v))
    # Totals of the blocks before, in blocks again.
    outer = F.flatten(F.transform(_pairs(before), lambda p: F.transform(sums(p["part"]), lambda s: s + p["base"])))
    shifted = F.zip_with(inner, F.slice(F.concat(F.array(F.lit(0).cast("long")), outer), 1, F.size(inner)), lambda s, base: F.transform(s, lambda v: v + base))
    return F.when(F.size(values) > 0, F.flatten(shifted)).otherwise(F.array().cast("array<bigint>"))


def _pairs(totals: Column) -> Column:
    """Blocks of block totals, with the sum of all before; a text of 2**24 matches has 256 of them."""
    index = F.sequence(F.lit(1).cast("long"), F.ceil(F.size(totals) / BLOCK))
    return F.transform(index, lambda b: F.struct(
        F.slice(totals, ((b - 1) * BLOCK + 1).cast("int"), BLOCK).alias("part"),
        F.aggregate(F.slice(totals, 1, ((b - 1) * BLOCK).cast("int")), F.lit(0).cast("long"), lambda acc, v: acc + v).alias("base")))


def _score(prior: str, kind: str, before: Column, after: Column, checked: bool = False) -> Column:
    here = F.translate(F.concat(F.right(before, F.lit(BEFORE)), F.lit(" # "), F.left(after, F.lit(AFTER))), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    speaks = lambda words, weight: F.when(here.rlike(near(words)), weight).otherwise(0)
    return F.lit(PRIOR[prior] + CHECKSUM * checked) + speaks(WORDS[kind], FOR) + speaks(AGAINST_WORDS, AGAINST)


def near(words: str) -> str:
    return f"(^|[^a-z])({words.replace(' ', '|')})([^a-z]|$)"


def _span(kind: str, start: Column, end: Column, found: Column, score: Column, base: bool) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), found.alias("found"),
                    score.cast("int").alias("score"), F.lit(base).alias("base"))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether at most 20 digits pass: every second one from the right counts double, nines cast out."""
    values = F.transform(F.split(F.lpad(digits, 20, "0"), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int")).otherwise(
        2 * d.cast("int") - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v) % 10 == 0


def mod97(compact: Column) -> Column:
    """The remainder of an IBAN, its first four characters moved to the end and letters read as 10 to 35."""
    turned = F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))
    value = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: (acc * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97)


def _email(found, start, end, before, after):
    return _span("email", start, end, found, _score("email", "email", before, after), True)


def _ip(found, start, end, before, after):
    part = lambda p: F.regexp_replace(p, "^0+", "")
    fits = F.forall(F.split(found, r"\."), lambda p: (F.length(part(p)) <= 2) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    return F.when(fits, _span("ip", start, end, found, _score("ip", "ip", before, after), True))


def _card(found, start, end, before, after):
    digits, score = _digits(found), _score("inner_card", "card", before, after, True)
    lead, inner = F.regexp_extract(found, INSIDE, 1), F.regexp_extract(found, INSIDE, 2)
    at = start + F.length(lead)
    return (
        F.when(F.length(digits).between(16, 19) & luhn(digits), _span("card", start, end, found, _score("card", "card", before, after, True), True))
        .when(score < ACCEPTED, F.lit(None))
        .when(F.length(digits).between(13, 15) & luhn(digits), _span("card", start, end, found, score, False))
        .when((F.length(digits) > 16) & (inner != "") & luhn(_digits(inner)), _span("card", at, at + F.length(inner), inner, score, False))
    )


def _phone(found, start, end, before, after):
    size, score = F.length(_digits(found)), _score("national", "phone", before, after)
    alone = ~before.rlike("[0-9][ .-]?$") & ~after.rlike("^[ .-]?[0-9]")
    return (
        F.when(found.startswith("+") & size.between(8, 15), _span("phone", start, end, found, _score("phone", "phone", before, after), True))
        .when(~found.startswith("+") & (score >= ACCEPTED) & alone, _span("phone", start, end, found, score, False))
    )


def _iban(found, start, end, before, after):
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
    size = F.try_element_at(lengths, F.left(found, F.lit(2)))
    own = F.coalesce(F.regexp_substr(found, F.concat(F.lit("^[A-Z0-9](?: ?[A-Z0-9]){"), F.coalesce(size - 1, F.lit(0)), F.lit("}"))), F.lit(""))
    compact = F.regexp_replace(own, " ", "")
    score = _score("iban", "iban", before, after, True)
    rest = F.concat(F.substr(found, F.length(own) + 1), after)
    alone = ~before.rlike("[A-Za-z0-9]$") & ~rest.rlike("^[A-Za-z0-9]")
    good = size.isNotNull() & (own != "") & (F.length(compact) == size) & alone
    return F.when(good & (score >= ACCEPTED) & (mod97(compact) == 1), _span("iban", start, start + F.length(own), own, score, False))


_SPANS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "iban": _iban}


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
