"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (octets, Luhn, digit
counts, mod 97), and context words near a span adjust its score. Per kind,
matches are leftmost, greedy and non-overlapping; a match that its validator
rejects is dropped and not tried again at a later character.

The patterns are written so that each runs in linear time and without deep
recursion: groups are possessive, and a match may begin inside a run of its own
characters only where the last match ended. Places come from running sums over
the text between matches, and replaced texts are joined from pieces, so the work
grows with the text and the number of spans, not with their product.

A null text is the empty text: no spans. Texts of any length are read whole.
Repeated rows are repeated results; of spans that start at the same place the
longest names a replacement, of equal ones the kind that sorts first. Empty tables
give empty tables. Other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import free_name

_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of digits with single separators; only runs of 13 to 19 digits can pass.
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Characters of an IBAN, by country.
_IBAN_LENGTHS = """
AD 24 AE 23 AL 28 AT 20 AZ 28 BA 20 BE 16 BG 22 BH 22 BI 27 BR 29 BY 28 CH 21 CR 22 CY 28 CZ 24 DE 22 DJ 27 DK 18
DO 28 EE 20 EG 29 ES 24 FI 18 FK 18 FO 18 FR 27 GB 22 GE 22 GI 23 GL 18 GR 27 GT 28 HN 28 HR 21 HU 28 IE 22 IL 23
IQ 23 IS 26 IT 27 JO 30 KW 30 KZ 20 LB 28 LC 32 LI 21 LT 20 LU 20 LV 21 LY 25 MC 27 MD 24 ME 22 MK 19 MN 20 MR 27
MT 31 MU 30 NI 28 NL 18 NO 15 OM 23 PK 24 PL 28 PS 29 PT 25 QA 29 RO 24 RS 22 RU 33 SA 24 SC 31 SD 18 SE 24 SI 19
SK 24 SM 27 SO 23 ST 25 SV 28 TL 23 TN 24 TR 26 UA 29 VA 22 VG 24 XK 20 YE 30
"""


def _iban() -> str:
    """The length by country ends a match, whatever follows it."""
    words = _IBAN_LENGTHS.split()
    by_length: dict[int, list[str]] = {}
    for country, n in zip(words[::2], words[1::2], strict=True):
        by_length.setdefault(int(n), []).append(country)
    return r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items())) + ")"


_IBAN = _iban()
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

BASE = ("email", "ip", "card", "phone")
#: Kinds in their order in a list of spans: the base kinds, then those that the method adds.
KINDS = (*BASE, "iban", "ssn")
#: Characters that prove a text cannot hold a kind; spares the pattern.
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
_PATTERN = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE, "iban": _IBAN, "ssn": _SSN}
#: Score of a confirmed span, without context. A checksum says more than a shape.
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.95, "ssn": 0.3}
#: Words that make a kind likelier if they stand near it, and words that speak against it.
_FOR = {
    "email": "mail|contact|reply|write to",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|master|amex|credit|debit|pay",
    "phone": "phone|call|tel|mobile|fax|dial",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security",
}
_AGAINST = "version|isbn|sample|example|test"
#: Characters before and after a span in which context words count.
CONTEXT = 40
#: Base kinds are kept whatever their score; added kinds need as much.
LEAST_SCORE = 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    d = F.reverse(_digits(match))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(d, i, F.lit(1)).cast("int") + 1)),
    )
    return F.length(d).between(13, 19) & (total % 10 == 0)


def _octets(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda x: F.length(F.ltrim(x, F.lit("0"))).between(0, 3) & (F.substring(F.ltrim(x, F.lit("0")), 1, 3).try_cast("int").isNull() | (F.substring(F.ltrim(x, F.lit("0")), 1, 3).try_cast("int") <= 255)))


def _mod97(match: Column) -> Column:
    s = F.replace(match, F.lit(" "), F.lit(""))
    s = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(s)),
        F.lit(0),
        lambda r, i: F.when(
            F.instr(F.lit(letters), F.substring(s, i, F.lit(1))) > 0, (r * 100 + F.ascii(F.substring(s, i, F.lit(1))) - 55) % 97
        ).otherwise((r * 10 + F.ascii(F.substring(s, i, F.lit(1))) - 48) % 97),
    )
    return F.length(s).between(15, 34) & (rest == 1)


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": _mod97,
    "ssn": lambda m: ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"),
}


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements that a running value is folded over at a time.
_CHUNK = 64


def _running(values: Column, zero: Column, fold) -> Column:
    """Of an array, for each element the fold of all before it, and last of all: one more than ``values`` has.

    Chunks are folded first, so an element costs a chunk and each chunk all chunks before it.
    """

    def of(v: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor(F.size(v) / _CHUNK).cast("int"))
        parts = F.transform(chunks, lambda k: F.slice(v, k * _CHUNK + 1, F.lit(_CHUNK)))
        folded = F.transform(parts, lambda part: F.aggregate(part, zero, fold))
        return _bound(
            F.struct(parts.alias("parts"), folded.alias("folded")),
            lambda x: F.flatten(
                F.transform(
                    x["parts"],
                    lambda part, k: _bound(
                        F.aggregate(F.slice(x["folded"], 1, k), zero, fold),
                        lambda base: F.transform(F.sequence(F.lit(0), F.when(k == F.size(x["parts"]) - 1, F.size(part)).otherwise(_CHUNK - 1)), lambda i: F.aggregate(F.slice(part, 1, i), base, fold)),
                    ),
                )
            ),
        )

    return _bound(values, of)


def _sums(lengths: Column) -> Column:
    return _running(lengths, F.lit(0), lambda a, b: a + b)


#: What may stand between the members of a list: separators and a conjunction.
_LIST_GAP = r"^[\s,;/|&-]*(?:and|or|und|oder|et|ou|y|o)?[\s,;/|&-]*$"


def _score(kind: str, around: Column) -> Column:
    """The kind's prior, raised or lowered by the words within ``CONTEXT`` characters."""

    def of(words: Column) -> Column:
        score = F.lit(_PRIOR[kind]) + F.when(words.rlike(rf"\b(?:{_FOR[kind]})"), 0.3).otherwise(0.0) - F.when(words.rlike(rf"\b(?:{_AGAINST})\b"), 0.2).otherwise(0.0)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))

    return _bound(F.lower(around), of)


_SHAPE = "array<struct<kind:string,start:int,end:int,score:double>>"


def _spans(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind: array of (kind, start, end, score); code points from 0, end exclusive.

    Context is the ``CONTEXT`` characters before and after a span. Other matches of
    the kind do not count among them, nor do the commas and conjunctions between
    them: all members of a list have the words before and after the list.
    """
    pattern = _PATTERN[kind]

    def measured(x: Column) -> Column:
        gaps, matches = x["gaps"], x["matches"]
        lengths = F.zip_with(F.transform(gaps, F.length), F.transform(matches, F.length), lambda gap, m: gap + F.coalesce(m, F.lit(0)))
        # words between matches, unless these are members of one list: the edges always count
        said = F.transform(gaps, lambda gap, i: F.when((i == 0) | (i == F.size(gaps) - 1) | ~gap.rlike(_LIST_GAP), F.when(F.length(gap) > 2 * CONTEXT, F.concat(F.left(gap, F.lit(CONTEXT)), F.lit(" "), F.right(gap, F.lit(CONTEXT)))).otherwise(gap)))
        return F.struct(matches.alias("matches"), _sums(lengths).alias("at"), F.transform(gaps, F.length).alias("gap"), said.alias("said"))

    def ranked(x: Column) -> Column:
        rank = _sums(F.transform(x["said"], lambda y: y.isNotNull().cast("int")))
        return F.struct(x["matches"].alias("matches"), x["at"].alias("at"), x["gap"].alias("gap"), F.filter(x["said"], lambda y: y.isNotNull()).alias("said"), rank.alias("rank"))

    def confirmed(x: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            start = F.element_at(x["at"], i + 1) + F.element_at(x["gap"], i + 1)
            score = _score(kind, _around(x["said"], F.element_at(x["rank"], i + 2)))
            return F.when(_VALID[kind](m), F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), score.alias("score")))

        return F.filter(F.transform(x["matches"], span), lambda s: s.isNotNull())

    proposed = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    possible = text.rlike(pattern) if kind not in _NEEDS else F.contains(text, F.lit(_NEEDS[kind])) & text.rlike(pattern)
    return F.when(possible, _bound(_bound(_bound(proposed, measured), ranked), confirmed)).otherwise(F.array().cast(_SHAPE))


def _around(said: Column, rank: Column) -> Column:
    """The last ``CONTEXT`` characters of the ``rank`` first strings, and the first of the others; the strings lie apart by a space."""
    before = F.array_join(F.slice(said, F.greatest(rank - CONTEXT // 2, F.lit(0)) + 1, F.least(rank, F.lit(CONTEXT // 2))), " ")
    after = F.array_join(F.slice(said, rank + 1, F.lit(CONTEXT // 2)), " ")
    return F.concat(F.right(before, F.lit(CONTEXT)), F.lit(" "), F.left(after, F.lit(CONTEXT)))


def pii_spans(docs: DataFrame, text_col: str = "text", output: str = "spans") -> DataFrame:
    """``docs`` with ``output``: array of (kind, start, end, score), by kind as in ``KINDS``, then start.

    Base kinds stay whatever their score; added kinds need ``LEAST_SCORE``.
    Every other column of ``docs`` passes through.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.concat(*(_spans(kind, text) for kind in KINDS))
    return docs.withColumn(output, F.filter(found, lambda x: x["kind"].isin(*BASE) | (x["score"] >= LEAST_SCORE)))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per document: counts by base kind, the digest of the base spans, and all spans written out."""
    found = pii_spans(docs.select("doc_id", F.col("text")), "text", "found").select("doc_id", "found")

    def is_kind(kind: str):
        return lambda x: x["kind"] == kind

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *(F.size(F.filter("found", is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(written(F.filter("found", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )


#: Characters of the blocks that a text is cut into, so that a piece is found without counting from the text's start.
_BLOCK = 1024


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of a text in blocks."""
    first = F.floor(start / _BLOCK).cast("int")
    joined = F.array_join(F.slice(blocks, first + 1, F.floor(end / _BLOCK).cast("int") - first + 1), "")
    return F.substring(joined, start - first * _BLOCK + 1, end - start)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data in ``text_col`` replaced by its kind in brackets.

    Of overlapping spans the one that starts first (then the longest) names the
    replacement, and what the others cover beyond it goes with it. A null text
    stays null. Columns and their order stay.
    """
    names, own = docs.columns, free_name(docs, "_spans")
    text = F.col(text_col)
    found = pii_spans(docs, text_col, own)
    ordered = F.array_sort(F.transform(own, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus_end"), x["kind"].alias("kind"))))

    def built(spans: Column) -> Column:
        # what is covered before each span, and in all; a span that starts beyond it is replaced
        covered = _running(F.transform(spans, lambda x: -x["minus_end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        return _bound(
            F.struct(covered.alias("covered"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)).alias("blocks")),
            lambda y: F.concat(
                F.array_join(
                    F.transform(
                        F.filter(F.zip_with(spans, y["covered"], lambda x, c: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), c.alias("covered"))), lambda x: x["start"] >= x["covered"]),
                        lambda x: F.concat(_piece(y["blocks"], x["covered"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")),
                    ),
                    "",
                ),
                _piece(y["blocks"], F.element_at(y["covered"], -1), F.length(text)),
            ),
        )

    return found.withColumn(text_col, F.when(F.size(own) > 0, _bound(ordered, built)).otherwise(text)).select(*names)
