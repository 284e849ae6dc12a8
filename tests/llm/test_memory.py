"""What a worker needs of memory, measured on small inputs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import zstandard

from attesta.llm import suffix_dedup


def _bucket(n: int) -> pa.Table:
    """Two chunks' packets of n bytes each, as suffixes of 80 bytes of which a third is in both."""
    rng, pack = np.random.default_rng(4), zstandard.ZstdCompressor(1)
    shared = rng.integers(97, 123, (n // 240, 80), np.uint8)
    rows = []
    for chunk in (0, 1):
        own = np.concatenate([shared, rng.integers(97, 123, (n // 80 - len(shared), 80), np.uint8)])
        meta = np.concatenate([np.full(len(own), 80), np.full(len(own), chunk)]).astype(np.int64)
        rows.append((chunk, suffix_dedup._SUFFIX, 0, np.arange(len(own), dtype=np.uint32).tobytes(), pack.compress(own.tobytes()), pack.compress(meta.tobytes()), None))
    return suffix_dedup._table(rows)


def test_sorting_a_bucket_takes_few_bytes_a_byte():
    n = 400_000
    table = _bucket(n)
    suffix_dedup._sort(table)
    tracemalloc.start()
    out = suffix_dedup._sort(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["chunk"].to_pylist() == [1]
    found = np.frombuffer(zstandard.ZstdDecompressor().decompress(out["a"][0].as_py()), np.int64).reshape(4, -1)
    assert found.tolist() == [list(range(n // 240)), [0] * (n // 240), [30] * (n // 240), [0] * (n // 240)]
    assert peak < 32 * 2 * n, peak / (2 * n)
