"""Who is who: alias pairs by blocked joins, clusters that are cliques, canonical people, scores of a clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import compact_key, folded, plausibly_same, words
from talkmill.session import checkpointed
from talkmill.tables import dealt


#: Names that a unit of work pairs with the others of their block; larger blocks are dealt into more units.
UNIT = 250


def blocked(people: DataFrame) -> DataFrame:
    """(name, first, second): each name once, with its first two words in lower case; the second of a name of one word is empty."""
    w = words(F.lower(F.col("name")))
    rows = people.select("name", F.get(w, F.lit(0)).alias("first"), F.coalesce(F.get(w, F.lit(1)), F.lit("")).alias("second"))
    return rows.where("first is not null").distinct()


def _pairs(rows: DataFrame, n: int | None) -> DataFrame:
    """(a, b): the likely pairs of rows of `blocked`, each made once, in n tasks.

    Names of two words or more meet those with the same first two words and, in the block of an empty second word, the names that are just that first word.
    """
    keys = ["first", "second"]
    left = rows.where("second <> ''").select("name", "first", F.explode(F.array("second", F.lit(""))).alias("second"))
    units = F.ceil(F.col("size") / UNIT).cast("int")
    # Each longer name is in two blocks, so that at most two blocks in UNIT names have more than one unit.
    large = F.broadcast(left.groupBy(keys).agg(F.count("*").alias("size")).where(F.col("size") > UNIT).select(*keys, units.alias("units")))
    low = F.xxhash64(F.lower("name"))
    left = left.join(large, keys, "left").select(*keys, F.coalesce(F.pmod(F.xxhash64("name"), "units").cast("int"), F.lit(0)).alias("unit"), F.col("name").alias("x"), low.alias("low_x"))
    right = rows.join(large, keys, "left").select(*keys, F.explode(F.sequence(F.lit(0), F.coalesce("units", F.lit(1)) - 1)).alias("unit"), F.col("name").alias("y"), low.alias("low_y"))
    pairs = dealt(left, n, *keys, "unit").join(dealt(right, n, *keys, "unit"), [*keys, "unit"])
    pairs = pairs.where("(second = '' or x < y) and (low_x <> low_y or lower(x) <> lower(y))")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def likely_pairs(people: DataFrame, n: int | None = None) -> DataFrame:
    """(a, b): names of which one shortens the other (`names_likely_same`), in n tasks.

    Names of two words or more meet those with the same first two words, and names of one word those with that first word. Names that meet are alike, if
    not only case tells them apart.
    """
    return _pairs(checkpointed(blocked(people)), n)


def deletions(key: Column, most: Column) -> Column:
    """A key and what is left of it when up to `most` (0 to 2) characters go, the first one aside."""
    places = lambda k: F.sequence(F.lit(2), F.length(k))
    cut = lambda k: F.when(F.length(k) >= 2, F.transform(places(k), lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))).otherwise(F.array().cast("array<string>"))
    once = F.when(most >= 1, cut(key)).otherwise(F.array().cast("array<string>"))
    twice = F.when(most >= 2, F.flatten(F.transform(once, cut))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(key), once, twice))


#: Letters of a key up to which its deletions are blocks; longer keys meet by their thirds.
SHORT = 20


def thirds(key: Column) -> Column:
    """The blocks of a long key: what stands where a key of its length, or of one or two letters less, has its thirds, moved by up to two letters.

    Two edits leave one third of the shorter key as it is, two letters away from its place at most. There are 45 blocks, however long the key is.
    """
    out = []
    for less in range(3):
        third = F.floor((F.length(key) - less) / 3).cast("int")
        for k in range(3):
            size = third if k < 2 else F.length(key) - less - 2 * third
            for move in range(-2, 3):
                at = k * third + 1 + move
                text = F.when((at >= 1) & (at + size - 1 <= F.length(key)), F.substring(key, at, size))
                out.append(F.concat(F.lit(f"{k}/"), (F.length(key) - less).cast("string"), F.lit("/"), F.hex(F.xxhash64(text)), text.substr(1, 8)))
    return F.array_compact(F.array(*out))


def near_keys(rows: DataFrame, name: str, key: str) -> DataFrame:
    """(name, block): the blocks in which keys with one initial and one edit (two, if the shorter has six letters) meet.

    Keys that are at most n edits apart have a form in common after at most n deletions on each side, so blocks stay small however many names there
    are. The forms of a key grow with the square of its length, so keys of over SHORT letters meet by their thirds instead; of those with up to
    two letters more both are blocks, as they may be near to keys of either kind.
    """
    k, none = F.col(key), F.array().cast("array<string>")
    most = F.when(F.length(k) >= 6, 2).otherwise(1)
    forms = F.when(F.length(k) <= SHORT + 2, deletions(k, most)).otherwise(none)
    parts = F.when(F.length(k) > SHORT, thirds(k)).otherwise(none)
    return rows.select(name, F.explode(F.array_distinct(F.concat(forms, parts))).alias("block"))


def plausible_pairs(people: DataFrame) -> DataFrame:
    """(a, b, reason): names with one key, or single words an edit or two apart."""
    rows = people.select("name", compact_key(F.col("name")).alias("key"), F.trim(folded(F.col("name"))).alias("plain")).where("key <> ''").distinct()
    same = rows.select("name", F.concat(F.lit("="), "key").alias("block"))
    near = near_keys(rows.where(F.size(words(F.col("plain"))) == 1), "name", "plain")
    blocks = same.unionByName(near)
    pairs = blocks.withColumnRenamed("name", "a").join(blocks.withColumnRenamed("name", "b"), "block").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("reason", plausibly_same(F.col("a"), F.col("b"))).where("reason is not null")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the least node that each node of edges (a, b) reaches; labels halve their way each round."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = step.select(F.col("node").alias("n"), F.col("new").alias("far"))
        after = checkpointed(step.join(jump, step["new"] == jump["n"]).select("node", F.least("new", "far").alias("label"), "old"))
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def clusters(pairs: DataFrame) -> DataFrame:
    """(members): components that are cliques; of others, each direct pair is a cluster. For pairs of any kind; `likely_clusters` knows those of its own."""
    edges = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    of = components(edges)
    sizes = of.groupBy("component").agg(F.count("*").alias("nodes"), F.array_sort(F.collect_list("node")).alias("members"))
    own = edges.join(of.withColumnRenamed("node", "a"), "a")
    counts = own.groupBy("component").agg(F.count("*").alias("edges"))
    rated = sizes.join(counts, "component").withColumn("clique", F.col("edges") == F.col("nodes") * (F.col("nodes") - 1) / 2)
    pairs_left = own.join(rated.where("not clique").select("component"), "component", "left_semi").select(F.array("a", "b").alias("members"))
    return rated.where("clique").select("members").unionByName(pairs_left)


def likely_clusters(people: DataFrame, n: int | None = None) -> DataFrame:
    """(members): the `clusters` of `likely_pairs`, in n tasks; blocks are counted, so that only the pairs of components that are no cliques are made.

    Of a block, all names are linked but those that only case tells apart. A name of one word is linked with all longer names of that first word, which are
    one component then; without such a name each block is one.
    """
    names, keys = checkpointed(blocked(people)), ["first", "second"]
    spelt = names.groupBy(*keys, F.lower("name")).agg(F.count("*").alias("n"))
    ends = F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))  # two for each link
    blocks = spelt.groupBy(keys).agg(F.sum("n").alias("n"), ends.alias("ends"))
    short = blocks.where("second = ''").select("first", F.col("n").alias("short"))
    blocks = blocks.join(short, "first", "left").withColumn("component", F.when(F.col("short").isNull(), F.col("second")).otherwise(F.lit("")))
    rated = blocks.groupBy("first", "component").agg(F.sum("n").alias("nodes"), F.sum("ends").alias("ends"), F.coalesce(F.max("short"), F.lit(0)).alias("short"))
    ends = F.col("ends") + 2 * F.col("short") * (F.col("nodes") - F.col("short"))
    rated = rated.where(ends > 0).select("first", "component", (ends == F.col("nodes") * (F.col("nodes") - 1)).alias("clique"))
    rows = checkpointed(names.join(blocks.join(rated, ["first", "component"]).select(*keys, "component", "clique"), keys))
    cliques = rows.where("clique").groupBy("first", "component").agg(F.array_sort(F.collect_list("name")).alias("members"))
    return cliques.select("members").unionByName(_pairs(rows.where("not clique").select("name", *keys), n).select(F.array("a", "b").alias("members")))


def b_cubed(rows: DataFrame) -> DataFrame:
    """One row with precision, recall and wrong merges of rows (item, cluster, truth), without pairing items.

    An item's precision is the share of its cluster with its truth, its recall the share of its truth in its cluster. A
    cluster of c items with several truths counts its pairs of different truths as wrong.
    """
    both = rows.groupBy("cluster", "truth").agg(F.count("*").alias("n"))
    by_cluster = both.groupBy("cluster").agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.col("n")).alias("same"))
    by_truth = both.groupBy("truth").agg(F.sum("n").alias("t"))
    scored = both.join(by_cluster, "cluster").join(by_truth, "truth")
    wrong = by_cluster.agg(((F.sum(F.col("c") * F.col("c")) - F.sum("same")) / 2).cast("long").alias("wrong_pairs"))
    score = scored.agg(
        F.round(F.sum(F.col("n") * F.col("n") / F.col("c")) / F.sum("n"), 6).alias("precision"),
        F.round(F.sum(F.col("n") * F.col("n") / F.col("t")) / F.sum("n"), 6).alias("recall"),
    )
    return score.join(wrong)  # two rows of one


def canonical(mentions: DataFrame, people: DataFrame) -> DataFrame:
    """(mention, person): each mention's person by exact name, else by key, support deciding; ties and unknown names: null.

    people: (person, alias, support). A rank shared by two people is ambiguous.
    """
    exact = people.groupBy(F.lower("alias").alias("k"), "person").agg(F.sum("support").alias("support"), F.lit(1).alias("tier"))
    keyed = people.groupBy(compact_key(F.col("alias")).alias("k"), "person").agg(F.sum("support").alias("support"), F.lit(0).alias("tier"))
    asked = mentions.select("mention").distinct()
    found = asked.withColumn("k", F.lower("mention")).join(exact, "k").unionByName(asked.withColumn("k", compact_key(F.col("mention"))).join(keyed, "k"))
    rank = F.struct("tier", "support")
    best = found.groupBy("mention").agg(F.max(rank).alias("best"))
    tops = found.join(best, "mention").where(rank == F.col("best")).groupBy("mention").agg(F.min("person").alias("person"), F.max("person").alias("other"))
    return asked.join(tops.where("person = other").select("mention", "person"), "mention", "left")
