"""Encoding with a public byte-level BPE vocabulary in Spark's own higher-order functions."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

# The pattern that splits text before the merges, with white space spelled out for Java.
SPACE = r"\t-\r \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
SLOTS = 8192
NONE = 2_000_000_000
HOT_WORDS = 65_536


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a line holds a piece in base 64 and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _slots(path: str) -> list[dict[str, int]]:
    """The rank map in slots by CRC-32 of the piece: a lookup compares a few keys, not all."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in read_ranks(path).items():
        key = piece.decode("latin-1")
        slots[zlib.crc32(key.encode()) % SLOTS][key] = rank
    return slots


def block_literal(spark: SparkSession, value: list, kind: str) -> Column:
    """A large array as one literal in Spark's binary form.

    Built from Column functions it would be an object for each entry in every
    copy of the plan, and printed whole in every event about it: some 400 MB
    for one query. The value of a one-row table is a single block of bytes
    (2 MB for the ranks), shared by all copies, and printed by its name.
    """
    cell = spark.createDataFrame([(value,)], f"v {kind}")._jdf
    block = cell.queryExecution().executedPlan().executeCollect()[0].getArray(0)
    literal = spark._jvm.org.apache.spark.sql.catalyst.expressions.Literal(block, cell.schema().apply(0).dataType())
    return ClassicColumn(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def encoder(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """Word -> array of ids: ranked merges folded over the word's bytes.

    Bytes are Latin-1 letters, so a piece is a string and pieces join by
    ``concat``. The rank map is one folded literal. A word that is a piece is its
    own encoding; else a fold merges the adjacent pair of lowest rank (the first
    of equals) until none has a rank, and looks up only the pairs that are new.
    A merged piece's id is the rank it was merged by.
    """
    table = block_literal(spark, _slots(path), "array<map<string,int>>")
    strings, numbers = F.array().cast("array<string>"), F.array().cast("array<int>")

    def ranks(pieces: Column) -> Column:
        slot = lambda p: F.element_at(table, F.pmod(F.crc32(p.cast("binary")), F.lit(SLOTS)).cast("int") + 1)
        return F.transform(pieces, lambda p: F.coalesce(F.element_at(slot(p), p), F.lit(NONE)))

    def merge(state: Column, _: Column) -> Column:
        p, i, r = state["p"], state["i"], state["r"]

        def at(m: Column, k: Column) -> Column:
            both = F.concat(F.element_at(p, k), F.element_at(p, k + 1))
            left = F.when(k > 1, F.array(F.concat(F.get(p, k - 2), both))).otherwise(strings)
            right = F.when(k + 2 <= F.size(p), F.array(F.concat(both, F.get(p, k + 1)))).otherwise(strings)
            pieces = F.concat(F.slice(p, 1, k - 1), F.array(both), F.slice(p, k + 2, F.size(p)))
            ids = F.concat(F.slice(i, 1, k - 1), F.array(m), F.slice(i, k + 2, F.size(i)))
            around = F.concat(F.slice(r, 1, F.greatest(k - 2, F.lit(0))), ranks(F.concat(left, right)), F.slice(r, k + 2, F.size(p)))
            return F.struct(pieces.alias("p"), ids.alias("i"), around.alias("r"))

        same = F.struct(p.alias("p"), i.alias("i"), r.alias("r"))
        low = F.coalesce(F.array_min(r), F.lit(NONE))
        # A one-element transform binds a value, so that it is worked out once.
        return _bind(low, lambda m: F.when(m == NONE, same).otherwise(_bind(F.array_position(r, m).cast("int"), lambda k: at(m, k))))

    def fold(w: Column, b: Column) -> Column:
        n = F.size(b)
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.element_at(b, i), F.element_at(b, i + 1)))).otherwise(strings)

        def run(r: Column) -> Column:  # ranks of the word, its bytes and their pairs
            start = F.struct(b.alias("p"), F.slice(r, 2, n).alias("i"), F.slice(r, n + 2, n).alias("r"))
            folded = F.aggregate(F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(numbers), start, merge, lambda s: s["i"])
            whole = F.element_at(r, 1)
            return F.when(whole < NONE, F.array(whole)).otherwise(folded)

        return _bind(ranks(F.concat(F.array(w), b, pairs)), run)

    def encode(word: Column) -> Column:
        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        return _bind(latin, lambda w: _bind(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(w, i, F.lit(1))), lambda b: fold(w, b)))

    return encode


def encode_words(words: DataFrame, word: str, path: str, out: str) -> DataFrame:
    """Add ``out``, the ids of ``word``."""
    return words.withColumn(out, encoder(words.sparkSession, path)(F.col(word)))


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))


def known_words(words: DataFrame, word: str, path: str, hot_words: int) -> Column:
    """A literal of slots by CRC-32: word -> ids, for the vocabulary's pieces and the most frequent other words.

    ``words`` holds a row for each occurrence. They are counted with map-side
    combining, and at most ``hot_words`` of those that are no piece are
    encoded, each once, in as many tasks as a shuffle has. Their ids, a list of
    fixed size whatever the corpus, come to the driver and go out with the plan.
    """
    spark = words.sparkSession
    whole = {}
    for piece, rank in read_ranks(path).items():
        try:
            whole[piece.decode()] = [rank]
        except UnicodeDecodeError:  # part of a letter: never a word
            continue
    pieces = _slot_literal(spark, ((w, True) for w in whole), "boolean")
    counts = words.groupBy(word).agg(F.count(F.lit(1)).alias("c")).filter(_in_slot(pieces, F.col(word)).isNull())
    hot = counts.orderBy(F.col("c").desc(), word).limit(hot_words).select(word)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = encode_words(hot.repartition(spread, word), word, path, "ids").toArrow()
    whole.update(zip(got[word].to_pylist(), got["ids"].to_pylist()))
    return _slot_literal(spark, whole.items(), "array<int>")


def _slot_literal(spark: SparkSession, entries: Iterable[tuple], kind: str) -> Column:
    slots: list[dict] = [{} for _ in range(SLOTS)]
    for w, v in entries:
        slots[zlib.crc32(w.encode()) % SLOTS][w] = v
    return block_literal(spark, slots, f"array<map<string,{kind}>>")


def _in_slot(table: Column, w: Column) -> Column:
    return F.element_at(F.element_at(table, F.pmod(F.crc32(w.cast("binary")), F.lit(SLOTS)).cast("int") + 1), w)


def encode_corpus(docs: DataFrame, doc_id: str, text: str, path: str, hot_words: int = HOT_WORDS) -> DataFrame:
    """Token ids of every document: doc_id, ids (array of int), without special tokens.

    Method: texts are split by the vocabulary's pattern. A first pass counts
    the words, and the ``hot_words`` most frequent of those that are no piece
    of the vocabulary are encoded once each by a fold of ranked merges
    (``encode_words``); their ids and the pieces go out as one literal. The
    second pass is a map over the documents: a word is looked up in the
    literal, and the distinct rest of a document is folded in place. Documents
    are never shuffled. The first pass runs when the plan is made.

    Defined cases: NULL, empty text: an empty list. Text like a special token
    is ordinary text. Each row gives one row, so repeated rows give repeated
    results. Long texts are encoded whole. Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("d"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("x"))
    table = known_words(rows.select(F.explode(split_words(F.col("x"))).alias("word")), "word", path, hot_words)
    looked = F.transform(split_words(F.col("x")), lambda w: F.struct(w.alias("w"), _in_slot(table, w).alias("ids")))
    encode = encoder(docs.sparkSession, path)

    def place(w: Column) -> Column:
        rare = F.array_distinct(F.transform(F.filter(w, lambda v: v["ids"].isNull()), lambda v: v["w"]))
        some = _bind(rare, lambda r: _bind(F.map_from_arrays(r, F.transform(r, encode)), lambda m: F.flatten(F.transform(w, lambda v: F.coalesce(v["ids"], F.element_at(m, v["w"]))))))
        return F.when(F.exists(w, lambda v: v["ids"].isNull()), some).otherwise(F.flatten(F.transform(w, lambda v: v["ids"])))

    return rows.select(F.col("d").alias(doc_id), _bind(looked, place).alias("ids"))


def decode_ids(rows: DataFrame, ids: str, path: str, out: str = "text") -> DataFrame:
    """Add ``out``: the binary pieces of the ids, joined in order and read as UTF-8."""
    pieces = {rank: piece for piece, rank in read_ranks(path).items()}
    top = max(pieces) + 1
    table = block_literal(rows.sparkSession, [pieces.get(i, b"").hex() for i in range(top)], "array<string>")
    joined = F.array_join(F.transform(F.col(ids), lambda i: F.element_at(table, i + 1)), "")
    return rows.withColumn(out, F.decode(F.unhex(joined), "UTF-8"))
