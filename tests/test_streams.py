"""Bursts as a stream against batch, over any batches."""

import random

import pytest

from tracewright.operators import segment
from tracewright.schemas import MESSAGES
from tracewright.streaming import streams

T0 = 1_758_304_234_000_000
DAY = 86_400


def chat(seed=1):
    """(channel, user, text, seconds): gaps around the limit, a burst of 130, a few marked, lone ones."""
    rng = random.Random(seed)
    rows, at = [], 0.0
    for k in range(120):
        at += rng.choice([1, 60, 2700, 2700.000001, 2699.999999, 4000])
        rows.append(("a", rng.choice("uvw"), f"a{k}", at, ["pushpin"] if k % 17 == 0 else []))
    rows += [("b", "u", f"b{k}", 500.0 + k * 20, []) for k in range(130)]
    rows += [("b", "v", "alone", 9.5 * DAY, []), ("c", "u", "one", 0.0, []), ("c", "u", "two", 2700.0, []), ("c", "u", "three", 5400.0, [])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_bursts_equal_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"C{c}", c, 2, u, u, t, T0 + round(s * 1_000_000), None, r) for c, u, t, s, r in chat(seed)]
    rows += [("Ca", "a", 2, "u", "u", "threaded", T0 + 10, T0, [])]
    whole = spark.createDataFrame(rows, MESSAGES)
    late = [r for r in rows if rng.random() < 0.3]  # these come after all others, within the lookback
    rest = [r for r in rows if r not in late]
    cut = sorted(rng.sample(range(len(rest)), 2))
    batches = [rest[: cut[0]], rest[cut[0] : cut[1]], rest[cut[1] :], late]
    end = lambda s: [("Cz", "z", 2, "u", "u", f"end{s}", T0 + s * 1_000_000, None, [])]
    source, at = str(tmp_path / "source"), str(tmp_path / "checkpoint")
    got = []
    for k, part in enumerate([*batches, end(40 * DAY), end(80 * DAY)]):
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3, 5):  # the stream stops and goes on from its state
            streams.stream_units(spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(source), lambda df, _: got.extend(df.collect()), at)
    want = segment.segment(whole).filter("kind = 'burst'").collect()
    key = lambda r: (r.channel_name, r.root_us, r.piece)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 5
    assert [r.message_count for r in sorted(got, key=key) if r.channel_name == "b"] == [60, 60, 10]
    assert [(r.channel_name, r.message_count) for r in got if r.channel_name == "c"] == [("c", 3)]
