"""A text over several blocks of 256 kB goes whole through the queries."""

import random
import shutil

import xxhash

from siftline.llm import registry


def test_long_text(spark, sf, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(110_000)]
    long = " ".join(words)
    assert len(long.encode()) > 600_000
    rows = [(1, long, "en", "a", len(long)), (2, "one two three four", "en", "a", 18), (3, long, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{sf}/labels.parquet", tmp_path / "labels.parquet")
    got = {name: {r.doc_id: r for r in registry.QUERIES[name](spark, str(tmp_path)).collect()} for name in ("op2_quality_llr", "op6_simhash_ball", "op7_source_mixing")}
    ones = [0] * 64
    for k in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    print_ = sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 2)
    for doc in (1, 3):
        q = got["op2_quality_llr"][doc]
        assert (q.n_words, q.word_chars, q.n_dup_lines) == (len(words), sum(map(len, words)), 0)
        assert int(got["op6_simhash_ball"][doc].fingerprint, 16) == print_ and got["op6_simhash_ball"][doc].component_id == 1
        assert got["op7_source_mixing"][doc].size == len(words)
