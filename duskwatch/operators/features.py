"""Vectors, vocabularies, augmentation and the bounded bank of reference vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.functions.text import tokens
from duskwatch.operators.samples import hash_sample
from duskwatch.plans.ordering import row_index
from duskwatch.plans.selection import values_at


def fit_vectorizer(rows: DataFrame, text: str = "text", dims: int = 256) -> PipelineModel:
    """Hashed term frequencies, inverse document frequency, unit length."""
    stages = [
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(rows.select(tokens(text).alias("_tokens")))


def vectorize(rows: DataFrame, model: PipelineModel, text: str = "text", out: str = "vec") -> DataFrame:
    done = model.transform(rows.withColumn("_tokens", tokens(text)))
    return done.withColumn(out, vector_to_array("_unit")).drop("_tokens", "_tf", "_idf", "_unit")


def tfidf_ngrams(rows: DataFrame, text: str = "text", size: int = 1000, min_df: int = 2, max_df: float = 0.8) -> PipelineModel:
    """TF-IDF over words and word pairs, the ``size`` most frequent terms."""
    from pyspark.ml.feature import CountVectorizer

    stages = [
        CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=size, minDF=min_df, maxDF=max_df),
        IDF(inputCol="_counts", outputCol="tfidf"),
    ]
    return Pipeline(stages=stages).fit(rows.select(_terms(text).alias("_terms")))


def _terms(text: str) -> Column:
    words = tokens(text)
    pairs = F.zip_with(
        words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
        lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)),
    )
    return F.concat(words, F.array_compact(pairs))


def apply_tfidf(rows: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    return model.transform(rows.withColumn("_terms", _terms(text))).drop("_terms", "_counts")


def build_vocabulary(rows: DataFrame, text: str = "text", size: int | None = 30_522) -> DataFrame:
    """``token, token_id``: the ``size`` most frequent words (all for None), ids from 1; 0 is padding.

    Words are ranked by falling frequency, ties by the word.
    """
    counted = rows.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    kept = counted if size is None else counted.orderBy(F.desc("n"), "token").limit(size)
    ranked = row_index(kept.withColumn("_down", -F.col("n")), ["_down", "token"])
    return ranked.select("token", (F.col("idx") + 1).alias("token_id"))


# Words of a vocabulary that is sent to every task; a larger one is joined by a shuffle.
BROADCAST_WORDS = 200_000


def token_ids(rows: DataFrame, vocabulary: DataFrame, key: str, text: str = "text", length: int | None = 128) -> DataFrame:
    """``key, ids``: id lists padded to ``length``; unknown words get ``vocabulary size + 1``.

    A list is ``length`` long by definition, so only its first ``length`` words
    are looked up; None takes every word and pads nothing. A vocabulary up to
    ``BROADCAST_WORDS`` words is a sorted array in every task and each text is
    coded where it lies; a larger one is joined word by word. A null text has no
    words.
    """
    known = vocabulary.count()
    unknown = known + 1
    words = F.coalesce(tokens(text), F.array().cast("array<string>"))
    words = words if length is None else F.slice(words, 1, length)
    if known <= BROADCAST_WORDS:
        coded = _coded_in_place(rows.select(key, words.alias("_w")), vocabulary, key, unknown)
    else:
        coded = _coded_by_join(rows.select(key, words.alias("_w")), vocabulary, key, unknown)
    if length is None:
        return coded
    padding = F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("ids"))
    return coded.select(key, F.concat("ids", padding).alias("ids"))


def _coded_in_place(listed: DataFrame, vocabulary: DataFrame, key: str, unknown: int) -> DataFrame:
    local = {r["token"]: r["token_id"] for r in vocabulary.select("token", "token_id").collect()}
    shared = listed.sparkSession.sparkContext.broadcast(local)

    @F.pandas_udf("array<bigint>")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = shared.value
        for lists in batches:
            yield lists.map(lambda words: [ids.get(w, unknown) for w in words])

    return listed.select(key, look_up("_w").alias("ids"))


def _coded_by_join(listed: DataFrame, vocabulary: DataFrame, key: str, unknown: int) -> DataFrame:
    words = listed.select(key, F.posexplode_outer("_w").alias("_at", "token"))
    looked = words.join(vocabulary, "token", "left")
    one = F.struct("_at", F.coalesce("token_id", F.lit(unknown)).alias("i"))
    gathered = looked.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), one))).alias("_l"))
    return gathered.select(key, F.transform("_l", lambda x: x["i"]).alias("ids"))


def augment(rows: DataFrame, key: str, text: str = "text", seed: int = 0, out: str = "augmented") -> DataFrame:
    """One changed copy of each text: words deleted, a span shuffled, or words replaced.

    The choice depends on the key and the seed only. Texts of up to three words
    stay as they are.
    """
    words = F.split(F.trim(text), r"\s+")
    n = F.size(words)

    def draw(tag: str, bound: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key), F.lit(f"{tag}{seed}")), bound.cast("long")).cast("int")

    def shuffled(positions: Column, tag: str) -> Column:
        keyed = F.transform(positions, lambda p: F.struct(F.xxhash64(F.col(key), p, F.lit(f"{tag}{seed}")).alias("h"), p.alias("p")))
        return F.transform(F.array_sort(keyed), lambda s: s["p"])

    positions = F.sequence(F.lit(0), n - 1)
    delete_count = draw("deletes", F.greatest(F.lit(1), F.floor(n * 0.3))) + 1
    deleted = F.slice(shuffled(positions, "delete"), 1, delete_count)
    after_delete = F.filter(words, lambda w, i: ~F.array_contains(deleted, i))

    span = draw("span", F.least(n, F.lit(5)) - 1) + 2
    start = draw("start", n - span + 1)
    mixed = shuffled(F.sequence(start, start + span - 1), "shuffle")
    after_shuffle = F.transform(
        words, lambda w, i: F.when(i.between(start, start + span - 1), F.get(words, F.get(mixed, i - start))).otherwise(w)
    )

    replace_count = draw("replaces", F.greatest(F.lit(1), F.floor(n * 0.2))) + 1
    replaced = F.slice(shuffled(positions, "replace"), 1, replace_count)
    noise = lambda w, i: F.substring(
        F.repeat(F.md5(F.concat_ws(":", F.col(key).cast("string"), i.cast("string"), F.lit(str(seed)))), 8),
        F.lit(1), F.greatest(F.lit(2), F.length(w)),
    )
    after_replace = F.transform(words, lambda w, i: F.when(F.array_contains(replaced, i), noise(w, i)).otherwise(w))

    strategy = draw("strategy", F.lit(3))
    changed = F.when(strategy == 0, after_delete).when(strategy == 1, after_shuffle).otherwise(after_replace)
    return rows.withColumn(out, F.when(n <= 3, F.col(text)).otherwise(F.array_join(changed, " ")))


def mark_sample(rows: DataFrame, key: str, ratio: float = 0.5, seed: int = 0, out: str = "chosen") -> DataFrame:
    """Mark exactly ``floor(rows * ratio)`` rows, chosen by hash order of the key.

    The hash at the last chosen place is found by counting, so no row moves.
    Rows that share this hash (copies of one key, as a rule) are told apart by
    their key and, where that is equal too, by a number given to them alone.
    """
    wanted = int(rows.count() * ratio)
    hashed = rows.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    if wanted == 0:
        return rows.withColumn(out, F.lit(False))
    place = values_at(hashed, "_h", [wanted - 1])[wanted - 1]
    if place.below + place.equal == wanted:
        return hashed.withColumn(out, F.col("_h") <= place.value).drop("_h")
    sure = hashed.filter(F.col("_h") != place.value).withColumn(out, F.col("_h") < place.value)
    tied = row_index(hashed.filter(F.col("_h") == place.value), [key], name="_n")
    return sure.unionByName(tied.withColumn(out, F.col("_n") < wanted - place.below).drop("_n")).drop("_h")


def build_bank(rows: DataFrame, key: str, vec: str = "vec", limit: int | None = None) -> DataFrame:
    """The bank of reference vectors ``bank_id, vec``: all rows, or ``limit`` rows in hash order if asked for."""
    if limit is None:
        return rows.select(F.col(key).alias("bank_id"), F.col(vec).alias("vec"))
    return hash_sample(rows.select(F.col(key).alias("bank_id"), F.col(vec).alias("vec")), "bank_id", limit)


def bank_from_normal_lines(lines: DataFrame, size: int = 10, dims: int = 256) -> tuple[DataFrame, PipelineModel]:
    """Bank and vectorizer from windows of normal lines; needs ten windows."""
    from duskwatch.operators.windows import fixed_windows
    from duskwatch.plans.ordering import freeze

    windows = freeze(fixed_windows(lines, size))
    if windows.limit(fixed.BANK_MINIMUM).count() < fixed.BANK_MINIMUM:
        raise ValueError(f"at least {fixed.BANK_MINIMUM} windows of normal lines are needed")
    model = fit_vectorizer(windows, dims=dims)
    # a dense index is a unique id, which a hash of the two keys is not
    vectors = vectorize(windows, model).select("seq_id", "window_idx", "vec")
    return build_bank(row_index(vectors, ["seq_id", "window_idx"]), "idx"), model


def save_bank(bank: DataFrame, stats: DataFrame, path: str) -> None:
    """Store a bank and the running score statistics of its methods."""
    bank.write.mode("overwrite").parquet(f"{path}/bank")
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def load_bank(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/bank"), spark.read.parquet(f"{path}/stats")
