"""Texts as parts: bounded, in order, and joined the whole again."""

import hashlib

import pytest
from pyspark.sql import functions as F

from folioscan.operators import long_texts as T


@pytest.mark.parametrize("sep", ["\n", "\n\n", ""])
def test_parts_are_the_text(spark, tmp_path, sep):
    # One group holds most rows; some pieces are longer than a part, some empty or null, and one key is null.
    rows = [("hot", i, f"piece {i} " * (i % 7) + ("x" * 900 if i % 50 == 3 else "")) for i in range(400)]
    rows += [("cold", 1, "a"), ("cold", 2, None), ("cold", 3, ""), ("cold", 4, "b"), (None, 1, "n"), (None, 2, "ö" * 300)]
    df = spark.createDataFrame(rows, "g string, i int, t string").withColumn("start", F.lit("clash")).repartition(8)
    want = {g: sep.join(t for k, _, t in sorted(rows, key=lambda r: r[1]) if k == g and t is not None) for g in ("hot", "cold", None)}
    parts = T.text_parts(df, ["g"], ["i"], "t", sep, 200)
    T.write_parts(parts, ["g"], str(tmp_path / "parts"))
    back = spark.read.parquet(str(tmp_path / "parts"))
    for g, whole in want.items():
        assert "".join(T.read_text(back, "t", sep, g=g)) == whole
    for r in back.collect():
        assert r.n_chars == len(r.t) < 200 + 1000 + len(sep)
        assert want[r.g][r.start:].startswith(r.t)
    assert back.filter("g = 'hot'").count() > 20
    listed = {r.g: (r.n_pieces, r.n_chars) for r in T.manifest(back, ["g"]).collect()}
    assert listed == {"hot": (400, len(want["hot"])), "cold": (3, len(want["cold"])), None: (2, len(want[None]))}
    assert T.text_parts(df.limit(0), ["g"], ["i"], "t", sep).count() == 0


def test_no_task_holds_a_long_group(spark, tmp_path):
    # One group of 60 million characters: its parts are put together apart from each other.
    df = spark.range(600, numPartitions=8).select(
        F.lit(1).alias("g"), F.col("id").alias("i"), F.repeat(F.format_string("%09d ", "id"), 10_000).alias("t"))
    parts = T.text_parts(df, ["g"], ["i"], "t", "\n", 2_000_000)
    T.write_parts(parts, ["g"], str(tmp_path / "parts"))
    back = spark.read.parquet(str(tmp_path / "parts"))
    assert back.count() == len({i * 100_001 // 2_000_000 for i in range(600)}) and back.agg(F.max("n_chars")).first()[0] < 2_200_000
    whole, want = hashlib.sha256(), hashlib.sha256()
    for piece in T.read_text(back, "t", "\n", g=1):
        whole.update(piece.encode())
    want.update("\n".join(f"{i:09d} " * 10_000 for i in range(600)).encode())
    assert whole.hexdigest() == want.hexdigest()
