"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

All steps are DataFrame functions. A regular expression gives matches without offsets, so a text is also split at the
matches: the lengths of the pieces and of the matches before a match add up to its start.

The patterns are possessive and start only where a run of their characters starts (or the match before ended), which
finds the same matches as the plain forms beside them, in linear time on long runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Countries by the length of their account numbers. Fixed values.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
ACCOUNT = "(?:" + "|".join(f"(?:{own.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, own in ACCOUNT_LENGTHS.items()) + ")"
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double,match:string>>"
BLOCK = 128


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's checksum."""

    def weight(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((F.length(number) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), weight) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number, moved by four places and its letters as numbers from 10, leaves 1 modulo 97."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c > 57, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), step) == 1


def parts_to_255(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def digits_between(match: Column, least: int, most: int) -> Column:
    return F.length(digits(match)).between(least, most)


def card(match: Column) -> Column:
    number = digits(match)
    return digits_between(match, 16, 19) & F.when(digits_between(match, 16, 19), luhn(number)).otherwise(False)


def account(match: Column) -> Column:
    return mod97(F.regexp_replace(match, " ", ""))


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. `maybe` is a cheap test that a text with a match passes.

    The score is `prior`, plus `boost` if one of the `near` words stands whole in the `reach` characters before or after
    the span; spans below `least` are not reported. `alone` asks that no ASCII letter or digit touch the span.
    """

    name: str
    pattern: str
    maybe: Callable[[Column], Column]
    valid: Callable[[Column], Column] = field(default=lambda match: F.lit(True))
    prior: float = 0.7
    near: tuple[str, ...] = ()
    boost: float = 0.2
    least: float = 0.0
    reach: int = 40
    alone: bool = False


#: The base kinds first, in the order of their listing.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"), prior=0.9, near=("mail", "email", "contact", "write to"), boost=0.1,
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind(
        "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"),
        parts_to_255, prior=0.6, near=("ip", "host", "address", "server", "login"),
    ),
    # [0-9]([\x20-]?[0-9])+
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        card, prior=0.8, near=("card", "cards", "visa", "credit", "pay", "payment"),
    ),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"),
        lambda m: digits_between(m, 8, 15), prior=0.7, near=("phone", "telephone", "call", "tel", "mobile", "fax"),
    ),
    Kind(
        "iban", ACCOUNT, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
        account, prior=0.9, near=("iban", "account", "bank"), boost=0.1, alone=True,
    ),
    # Three groups of digits may be anything, so a word nearby must confirm them.
    Kind(
        "ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), prior=0.4, near=("ssn", "social", "security"), boost=0.4, least=0.5, alone=True,
    ),
)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def spans(documents: DataFrame, kinds: tuple[Kind, ...] = KINDS, column: str = "text") -> DataFrame:
    """documents with `spans`: (kind, start, end, score, match), by kind as listed, then by start.

    Offsets are code points, the end exclusive. Matches of a kind are leftmost and do not overlap; those that fail
    their check are dropped, and the text inside them is not tried again. Null and empty texts have no
    spans. A `spans` column is replaced; other columns, repeated rows and null ids stay. No rows give no rows.
    """
    own = [F.col("_row")[c].alias(c) for c in documents.columns if c != "spans"]
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    rows = documents.select(F.struct("*").alias("_row"), text.alias("_text"))
    rows = rows.withColumns(
        {f"_cut_{k.name}": F.when(k.maybe(F.col("_text")), F.split("_text", k.pattern, -1)) for k in kinds}
        | {f"_hit_{k.name}": F.when(k.maybe(F.col("_text")), F.regexp_extract_all("_text", F.lit(k.pattern), F.lit(0))) for k in kinds}
    )

    def way(k: Kind) -> Column:
        """From the start of a match to the start of the next."""
        hits = F.col(f"_hit_{k.name}")
        before = lambda i: F.when(i > 0, F.char_length(F.element_at(hits, F.greatest(i, F.lit(1))))).otherwise(0)
        pieces = F.slice(f"_cut_{k.name}", F.lit(1), F.size(hits))
        return F.transform(pieces, lambda piece, i: (F.char_length(piece) + before(i)).cast("long"))

    def at(k: Kind) -> Column:
        """Running sums of the ways, in two levels, so that texts with very many matches stay cheap."""
        ways = F.col(f"_way_{k.name}")

        def block(b: Column) -> Column:
            own = F.slice(ways, b * BLOCK + 1, F.lit(BLOCK))
            sums = lambda before: F.transform(own, lambda x, i: before + _sum(F.slice(own, F.lit(1), i + 1)))
            return F.element_at(F.transform(F.array(_sum(F.slice(ways, F.lit(1), b * BLOCK))), sums), 1)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(ways) / BLOCK).cast("int")), block))

    rows = rows.select("_row", "_text", *(f"_hit_{k.name}" for k in kinds), *(way(k).alias(f"_way_{k.name}") for k in kinds))
    rows = rows.withColumns({f"_at_{k.name}": at(k) for k in kinds})

    def found(k: Kind) -> Column:
        both = F.filter(F.arrays_zip(F.col(f"_at_{k.name}").alias("at"), F.col(f"_hit_{k.name}").alias("hit")), lambda s: k.valid(s["hit"]))

        def scored(s: Column) -> Column:
            first = F.greatest(s["at"] - k.reach, F.lit(0)).cast("int")
            size = F.char_length(s["hit"])
            around = F.concat_ws(" ", F.substring("_text", first + 1, (s["at"] - first).cast("int")), F.substring("_text", (s["at"] + size + 1).cast("int"), F.lit(k.reach)))
            hint = F.lower(around).rlike(rf"(?:^|[^a-z0-9])(?:{'|'.join(k.near)})(?:[^a-z0-9]|$)")
            return F.struct(
                F.lit(k.name).alias("kind"), s["at"].alias("start"), (s["at"] + size).alias("end"),
                F.when(hint, k.prior + k.boost).otherwise(k.prior).alias("score"), s["hit"].alias("match"),
            )

        def apart(s: Column) -> Column:
            before = F.when(s["at"] > 0, F.substring("_text", s["at"].cast("int"), F.lit(1))).otherwise("")
            after = F.substring("_text", (s["at"] + F.char_length(s["hit"]) + 1).cast("int"), F.lit(1))
            return ~F.concat(before, after).rlike("[A-Za-z0-9]")

        if k.alone:
            both = F.filter(both, apart)
        return F.coalesce(F.filter(F.transform(both, scored), lambda s: s["score"] >= k.least), F.array().cast(SPAN))

    return rows.select(*own, F.concat(*(found(k) for k in kinds)).alias("spans"))


def count_of(kind: str) -> Column:
    """How many spans have that kind."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def spans_text(kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans (of those kinds), comma-joined."""
    chosen = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scores_text(kinds: tuple[str, ...] | None = None) -> Column:
    """The scores of the same spans in hundredths, comma-joined."""
    chosen = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def redacted(documents: DataFrame, column: str = "text", least: float = 0.5) -> DataFrame:
    """documents of `spans`, each span of at least that score replaced by its kind in brackets.

    Overlapping spans count by their first start; a later one that begins inside is left out.
    """
    empty = F.struct(F.lit(0).cast("long").alias("to"), F.lit("").alias("out"))
    text = F.coalesce(F.col(column), F.lit(""))
    chosen = F.array_sort(F.filter("spans", lambda s: s["score"] >= least), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))

    def put(state: Column, s: Column) -> Column:
        before = F.substring(text, (state["to"] + 1).cast("int"), (s["start"] - state["to"]).cast("int"))
        new = F.struct(s["end"].alias("to"), F.concat(state["out"], before, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        return F.when(s["start"] >= state["to"], new).otherwise(state)

    rest = lambda state: F.concat(state["out"], F.substring(text, (state["to"] + 1).cast("int"), F.char_length(text)))
    return documents.withColumn(column, F.aggregate(chosen, empty, put, rest))
