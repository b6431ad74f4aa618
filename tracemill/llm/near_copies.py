"""Groups of near-duplicate texts in one collection.

Method: deletion-variant signatures. A signature of 110 minwise symbols is cut into
22 segments; of each segment the five variants with one symbol left out are
indexed, so that two segments meet if they differ in at most one symbol. Equal keys
are joined, and pairs are verified on the whole texts. Symbols take the place of
bits: at a likeness of 0.6 two bit signatures of 128 bits differ in some 26 bits,
so that segments with at most one differing bit would be too short to tell texts
apart; the scheme holds for symbols of any alphabet. Sizes and two words of the
sketch travel with a key, so most chance meetings end inside the join.

Exact copies are one text from the start, whatever their number; every later step
works on distinct texts, and ids come back at the end. A key that very many texts
share makes one skewed partition of the join, which adaptive execution splits on one
side and repeats on the other; all its pairs are tested, as each like pair is asked for.

Defined results: null ids and texts of fewer than five letters and digits take part
in no pair; repeated rows change nothing; an id with several texts is linked through
any of them, and never to itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import likeness
from tracemill.session import Scratch


def distinct_texts(rows: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """(texts: scope, tid, digest, text, features and keys; members: scope, tid, id) of rows (scope, id, text).

    ``tid`` is a number that the written table gives each distinct text; ``digest`` names
    the text itself. Long keys are what the wide stages shuffle, so they carry the number.
    """
    plain = rows.select("scope", "id", likeness.plain(F.col("text")).alias("text")).where("id is not null and length(text) >= 5")
    plain = tmp.written(plain.withColumn("digest", likeness.text_id(F.col("scope"), F.col("text"))), "plain")
    texts = plain.groupBy("scope", "digest").agg(F.first("text").alias("text"))
    texts = texts.withColumn("f", likeness.deletion_features(F.col("text"))).select("scope", F.monotonically_increasing_id().alias("tid"), "digest", "text", "f.*")
    texts = tmp.written(texts, "texts")
    members = plain.select("scope", "digest", "id").distinct().join(texts.select("scope", "digest", "tid"), ["scope", "digest"])
    return texts, tmp.written(members.select("scope", "tid", "id"), "members")


def like_texts(texts: DataFrame, tmp: Scratch) -> DataFrame:
    """Pairs (a, b) of distinct like texts of one scope, a < b."""
    keys = texts.select("scope", "tid", "runs", "s0", "s1", F.explode("keys").alias("key")).select(F.xxhash64("scope", "key").alias("key"), "tid", "runs", "s0", "s1")
    x, y = keys.alias("x"), keys.alias("y")
    differ = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in ("s0", "s1")), F.lit(0))
    sizes = (likeness.LIKE_DEN * F.least("x.runs", "y.runs")) >= (likeness.LIKE_NUM * F.greatest("x.runs", "y.runs"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.tid") < F.col("y.tid")) & sizes & (differ <= 128 - likeness.TWO_AGREE))
    pairs = tmp.written(pairs.select(F.col("x.tid").alias("a"), F.col("y.tid").alias("b")).distinct(), "pairs")
    return tmp.written(likeness.verified(pairs, texts, texts), "like")


def like_ids(links: DataFrame, members: DataFrame) -> DataFrame:
    """(scope, id_a, id_b), id_a < id_b, of all ids that have like texts, by links between texts or a shared text."""
    m = members.alias("m")
    n = members.alias("n")
    ends = links.join(m, F.col("a") == F.col("m.tid")).select("m.scope", F.col("m.id").alias("u"), "b")
    across = ends.join(n, F.col("b") == F.col("n.tid")).select(ends["scope"], "u", F.col("n.id").alias("v")).where("u <> v")
    shared = m.join(n, (F.col("m.tid") == F.col("n.tid")) & (F.col("m.id") < F.col("n.id"))).select("m.scope", F.col("m.id").alias("u"), F.col("n.id").alias("v"))
    both = across.unionByName(shared).select("scope", F.least("u", "v").alias("id_a"), F.greatest("u", "v").alias("id_b"))
    return both.distinct()


def text_classes(texts: DataFrame, links: DataFrame, tmp: Scratch) -> DataFrame:
    """(tid, class_id): connected components of like texts; class_id is the least digest of the class.

    Each round takes every text's least neighbour label and then the label's own
    label (pointer jumping), so the rounds grow with the logarithm of the longest
    chain. Texts without links are their own class and never enter a round.
    """
    edges = tmp.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = tmp.written(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(near, "a").select("a", "label", F.least("label", "low").alias("low"))
        jump = step.select(F.col("a").alias("t"), F.col("low").alias("far"))
        new = tmp.written(step.join(jump, F.col("low") == F.col("t"), "left").select("a", F.col("label").alias("old"), F.least("low", F.coalesce("far", "low")).alias("label")), "labels")
        labels = new.select("a", "label")
        if new.where("old <> label").isEmpty():
            break
    own = texts.select("tid", "digest").join(labels, F.col("tid") == F.col("a"), "left").select("tid", "digest", F.coalesce("label", "tid").alias("label"))
    names = own.groupBy("label").agg(F.min("digest").alias("class_id"))
    return own.join(names, "label").select("tid", "class_id")
