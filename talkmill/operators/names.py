"""Names of people: hygiene, splitting, the user's own names, entities of a meeting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import slugify, words

# Fixed values.
ROLE_TITLES = (
    "engineering manager", "technical lead", "engineering lead", "product manager", "project manager", "product lead", "design lead", "senior engineer",
    "lead engineer", "principal engineer", "backend engineer", "frontend engineer", "software engineer", "core team", "team member", "team lead", "tech lead",
)
NOBODY = (
    "all", "none", "none identified", "not identified", "unknown", "unknown speaker", "unnamed", "unassigned", "everyone", "everybody", "anyone", "someone",
    "somebody", "nobody", "no one", "team", "the team", "team member", "team members", "group", "the group", "others", "attendee", "attendees", "participant",
    "participants", "speaker", "speakers",
)
GROUP_WORDS = (
    "team", "teams", "group", "groups", "devops", "ops", "qa", "member", "members", "new", "additional", "the", "a", "an", "engineering", "engineer", "developer",
    "dev", "owner", "manager", "lead", "leads", "staff", "crew", "admin", "intern", "analyst", "designer", "consultant",
)
INTRODUCTIONS = ("this is ", "hey, this is ", "hey this is ", "okay, this is ", "ok, this is ", "all right, this is ", "alright, this is ")

_ROLE = "(?:" + "|".join(r.replace(" ", "[ -]") for r in ROLE_TITLES) + ")"


def without_role(name: Column) -> Column:
    """A name without a role after it: behind a comma, a dash, in brackets at the end, after `from` or `the`, or as its last words."""
    n = F.trim(name)
    for marked in (rf"(?i)^(.*?), .*{_ROLE}.*$", rf"(?i)^(.*?) \([^()]*{_ROLE}[^()]*\)$", rf"(?i)^(.*?) [—–-] .*{_ROLE}.*$", rf"(?i)^(.+?) (?:from|the) .*{_ROLE}.*$", rf"(?i)^(.*?\S)[ -]+{_ROLE}$"):
        n = F.trim(F.regexp_replace(n, marked, "$1"))
    return n


def without_speaker_label(name: Column) -> Column:
    """A name without `speaker 1` at its end; empty if it is nothing else."""
    return F.regexp_replace(name, r"(?i)(?:^|[ -]+)speaker[ -]*[0-9]+\s*$", "")


def clean_name(name: Column, rounds: int = 3) -> Column:
    """Roles and speaker labels, stacked ones too, are gone; null if nothing or nobody in particular is left."""
    for _ in range(rounds):
        name = F.trim(without_speaker_label(without_role(name)))
    bare = F.trim(F.regexp_replace(F.translate(F.lower(name), "-", " "), r"\s+", " "))
    group = (F.size(words(bare)) >= 2) & F.forall(words(bare), lambda w: w.isin(*GROUP_WORDS))
    return F.when((bare != "") & ~bare.isin(*NOBODY) & ~group, name)


def people_of(text: Column) -> Column:
    """The names of a list: parted at `and`, `&`, `+` and `;`, and at commas if one of the first three is there; blanks are single, empty ones go."""
    t = F.coalesce(text, F.lit(""))
    joined = t.rlike(r"(?i)(?:^|\s)and(?:\s|$)|[&+]")
    parts = F.when(joined, F.split(t, r"(?i)(?:^|\s+)and(?=\s|$)|[&+;,]")).otherwise(F.split(t, ";"))
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def folded_user(people: DataFrame, key: str, name: str, aliases: tuple[str, ...]) -> DataFrame:
    """people (key, slug, label, aliases) in which the user's other names are aliases of the user, in the meetings where the user is present."""
    own = slugify(F.lit(name))
    others = [slugify(F.lit(a)) for a in aliases]
    there = people.where(F.col("slug") == own).select(key).distinct().withColumn("here", F.lit(True))
    rows = people.join(there, key, "left").withColumn("fold", F.col("here") & F.col("slug").isin(*others) if others else F.lit(False))
    rows = rows.withColumns({"fold": F.coalesce("fold", F.lit(False))})
    rows = rows.select(key, F.when(F.col("fold"), own).otherwise(F.col("slug")).alias("slug"), F.when(~F.col("fold"), F.col("label")).alias("label"), F.when(F.col("fold"), F.concat(F.array(F.lower("label")), F.col("aliases"))).otherwise(F.col("aliases")).alias("aliases"))
    return rows.groupBy(key, "slug").agg(F.min("label").alias("label"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))


def own_name_repaired(lines: DataFrame, present: DataFrame, name: str, variants: tuple[str, ...] = ()) -> DataFrame:
    """lines (doc_id, pos, line) of `[label] text` in which the user's name is spelt right where the user speaks of themselves.

    That is after an introduction such as `this is`, and before ` is ` at the start. A variant counts, and a word that the name begins
    with or that begins with the name and is one letter away. Only documents of `present` (doc_id) change.
    """
    rows = lines.join(present.select("doc_id").distinct().withColumn("here", F.lit(True)), "doc_id", "left")
    head, text = F.regexp_extract("line", r"^(.*?\] )", 1), F.regexp_replace("line", r"^.*?\] ", "")
    near = {v.lower() for v in (*variants, name[:-1]) if v} - {name.lower()}
    known = "|".join(sorted(f"\\Q{v}\\E" for v in near) + [f"\\Q{name}\\E[a-z0-9]"])
    opening = "|".join(INTRODUCTIONS)
    said = F.regexp_replace(text, rf"(?i)^({opening})(?:{known})(?![\p{{L}}\p{{N}}])", f"$1{name}")
    said = F.when(said != text, said).otherwise(F.regexp_replace(text, rf"(?i)^(?:{known})(?= is )", name))
    fixed = F.when(F.col("here") & (head != ""), F.concat(head, said)).otherwise(F.col("line"))
    return rows.select("doc_id", "pos", fixed.alias("line"))
