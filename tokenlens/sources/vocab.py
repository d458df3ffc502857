"""Tokenizer files -> vocabulary and merge tables (S8, P2 support).

``vocab(token STRING, token_id INT, token_bytes BINARY, is_special BOOLEAN)``: ``token`` is the
surface form (byte-level alphabet), ``token_bytes`` the raw bytes it stands for.
``merges(rank INT, left STRING, right STRING)``: merge pairs in rank order; pairs stored as
two-element lists or as ``"left right"`` strings are both accepted.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE alphabet, built from its rule: printable bytes stand for themselves,
    the other 68 bytes are shifted to code points 256, 257, ... in increasing byte order."""
    keep = list(range(ord("!"), ord("~") + 1)) + list(range(0xA1, 0xAC + 1)) + list(range(0xAE, 0xFF + 1))
    mapping = {b: b for b in keep}
    extra = 0
    for b in range(256):
        if b not in mapping:
            mapping[b] = 256 + extra
            extra += 1
    return {chr(cp): b for b, cp in mapping.items()}


def surface_to_bytes(token: Column) -> Column:
    """Raw bytes of a byte-level surface string (a 256-entry map: bounded literal)."""
    alpha = byte_alphabet()
    m = F.create_map(*[x for ch, b in sorted(alpha.items(), key=lambda kv: kv[1]) for x in (F.lit(ch), F.lit(b))])
    hexes = F.transform(F.split(token, ""), lambda ch: F.lpad(F.hex(F.element_at(m, ch)), 2, "0"))
    return F.unhex(F.array_join(hexes, ""))


TOKENIZER_SCHEMA = ("model struct<vocab: map<string,int>, merges: array<string>>, "
                    "added_tokens array<struct<id: int, content: string, special: boolean>>")


def tokenizer_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenizer_key(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()[:12]


def load_tokenizer_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read the tokenizer JSON with Spark's reader and return (vocab, merges)."""
    # the file's text is sent from the driver: executors needn't have the path
    text = spark.createDataFrame([(tokenizer_json(path),)], "t string")
    raw = text.select(F.from_json("t", TOKENIZER_SCHEMA).alias("j"),
                      F.coalesce(F.get_json_object("t", "$.model.merges[0][0]").isNotNull(), F.lit(False)).alias("pairs")).select("j.*", "pairs")
    added = raw.select(F.explode("added_tokens").alias("a")).select(
        F.col("a.id").alias("token_id"), F.col("a.content").alias("token"), F.coalesce("a.special", F.lit(False)).alias("is_special"))
    vocab = raw.select(F.explode("model.vocab").alias("token", "token_id"))
    # added tokens hold plain text, whether special or not and whether the model's vocabulary has
    # them or not; they are a handful of rows listed in the tokenizer file (bounded broadcast)
    learned = vocab.join(F.broadcast(added.select("token_id")), "token_id", "left_anti").select(
        "token", "token_id", surface_to_bytes(F.col("token")).alias("token_bytes"), F.lit(False).alias("is_special"))
    plain = added.select("token", "token_id", F.encode("token", "UTF-8").alias("token_bytes"), "is_special")
    vocab = learned.unionByName(plain).withColumn("token_id", F.col("token_id").cast("int"))
    # pairs or strings: one form per file. A pair reads as the JSON text of an array.
    m = raw.select("pairs", F.posexplode("model.merges").alias("rank", "m"))
    pair = F.when(F.col("pairs"), F.from_json("m", "array<string>")).otherwise(F.split("m", " ", 2))
    merges = m.select(F.col("rank").cast("int").alias("rank"), pair[0].alias("left"), pair[1].alias("right"))
    return vocab, merges
