"""Token counts through a digest cache.

Texts are joined by the SHA-256 of their normalised content and of the tokenizer's version to counts that
are already stored; only distinct misses are encoded, and their counts are appended to the cache.

The normalised content is the text with NULL as empty: the tokenizers here change nothing else before they
encode, and a coarser form could give two texts of different counts one digest. The version is the SHA-256
of the tokenizer's file and of the way it is called.

Defined results: NULL text counts as empty (0 tokens); repeated rows and texts each get their row; other
columns are ignored; an empty table gives no rows and appends nothing.
"""

import hashlib

from pyspark.sql import functions as F

from tablekeeper.functions.bitmaps import bitmap_of, may_hold
from tablekeeper.llm.tables import load, staged
from tablekeeper.session import work_dir
from tablekeeper.sources.files import exists

LIMIT = 4096
#: Words whose counts a task keeps; the memo starts anew when it is full.
MEMO_WORDS = 200_000
CALL = "encode/1: no begin, end or added tokens"


def version(path):
    """Digest of the tokenizer file and of how it is called."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + CALL.encode()).hexdigest()


def _by_word(model):
    """Whether words between single blanks encode on their own.

    So it is if the model changes no text beforehand and no piece holds a blank after another character.
    """
    blank = "▁"
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return (
        model.normalize("a  b\tc ﬁ") == f"{blank}a{blank}{blank}b\tc{blank}ﬁ"
        and not any(blank in piece.lstrip(blank) for piece in pieces)
    )


def _sentencepiece(path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if not _by_word(model):
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    memo = {"": 1}

    def count(text):
        if "  " in text or "▁" in text or text[:1] == " ":
            return len(model.encode(text))
        if not text:
            return 0
        words = text.split(" ")
        new = list({w for w in words if w not in memo})
        if new:
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                memo[""] = 1
                new = list(set(words) - {""})
            memo.update(zip(new, map(len, model.encode(new, num_threads=1))))
        return sum(map(memo.__getitem__, words))

    return lambda texts: [count(t) for t in texts]


def _tokenizers(path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


def counter(path):
    """Function from a list of texts to their token counts."""
    return _tokenizers(path) if path.endswith(".json") else _sentencepiece(path)


def encoded(texts, path):
    """``digest`` and ``n_tokens`` for rows of ``digest`` and ``text``."""

    def run(batches):
        import pyarrow as pa

        count = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
                )

    return texts.select("digest", "text").mapInArrow(run, "digest string, n_tokens long")


def read_cache(spark, cache, tokenizer):
    """Stored (digest, n_tokens) of one tokenizer version; none if the cache is new.

    Two runs may have stored the same text; it counts once.
    """
    schema = "digest string, n_tokens long, tokenizer string"
    if not exists(spark, cache):
        return spark.createDataFrame([], schema).drop("tokenizer")
    stored = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _once(rows):
    """Each distinct text once, combined before it is sent."""
    return rows.groupBy("digest").agg(F.any_value("text").alias("text"))


def token_counts(docs, path, cache, limit=LIMIT):
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row, through ``cache`` (a folder).

    Digests go around in narrow rows, and are looked up first; a bitmap of those that are missing tells which
    texts may be needed, so that texts in the cache stay where they are. A missing text is sent once from each task
    that reads it, and encoded once. A text that very many rows share makes one key with many narrow rows, which the
    adaptive join can split.
    """
    spark = docs.sparkSession
    tokenizer = version(path)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "digest", F.sha2("text", 256)
    )
    slim = staged(
        rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-digests"
    )
    distinct = slim.select("digest").distinct()
    if exists(spark, cache):
        misses = staged(distinct.join(read_cache(spark, cache, tokenizer), "digest", "left_anti"), "token-misses")
        number = F.xxhash64("digest")
        missing = bitmap_of(misses.select(number.alias("number")), misses.count())
        texts = _once(rows.where(may_hold(missing, number))).join(misses, "digest", "left_semi")
    else:
        texts = _once(rows)
    (
        encoded(texts, path).withColumn("tokenizer", F.lit(tokenizer))
        .write.mode("append").parquet(cache)
    )
    # Read back, so that a digest of very many rows can be split by the join.
    known = staged(read_cache(spark, cache, tokenizer).join(distinct, "digest", "left_semi"), "token-counts")
    return slim.join(known, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op4_token_counts(spark, folder):
    """Counts of all ``documents`` under piece_bpe_32k.model, from a cache that starts empty."""
    import public_tokenizers

    return token_counts(
        load(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
        work_dir(spark, "token-cache"),
    )
