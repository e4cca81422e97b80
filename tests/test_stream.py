import math
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import frame, hourly
from wattlane.operators import windows as W
from wattlane.operators.score import fit_forecast_models, score_series
from wattlane.session import ensure_checkpoint_dir
from wattlane.streaming.keyed import BLOCK, SEEN_TTL_MS, Seen
from wattlane.streaming.stream import replay, run_stream, stream_counts, time_slices

T0 = datetime(2024, 1, 1)


def run(spark, sliced, n, models=None, columns=("Power_Consumption",), **plan):
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    r = sliced.select("series_id", "ts", "arrival_no", *columns, "_slice")
    replay(r, f"{base}/in", n, lambda: run_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt",
                                                   r.drop("_slice").schema, models, **plan))
    counts = {x.series_id: (x.n_seen, x.late_rows, x.repeated_rows) for x in stream_counts(spark, f"{base}/ckpt").collect()}
    return spark.read.parquet(f"{base}/out").collect(), counts, base


def slices(spark, *batches):
    out = None
    for k, rows in enumerate(batches):
        part = frame(spark, rows).withColumn("_slice", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


@pytest.mark.parametrize("plan", [{}, {"hot_rows": 100, "chunk_rows": 200}])
def test_stream_equals_batch_for_in_order_input(spark, plan):
    rows = hourly(spark, 300, power=lambda i: float(i % 17)) + hourly(spark, 250, series="t", arrival_base=1000, power=lambda i: float(i % 5))
    df = frame(spark, rows)
    got, counts, _ = run(spark, time_slices(df, 3), 3, **plan)
    batch = {r["arrival_no"]: r for r in W.serving_features(df, impute=False, drop_warmup=False).collect()}
    assert len(got) == len(rows) and counts == {"s": (300, 0, 0), "t": (250, 0, 0)}
    for r in got:
        b = batch[r["arrival_no"]]
        for c in ("energy_lag_1", "energy_lag_24", "energy_lag_168", "energy_min_24h", "energy_max_24h"):
            assert r[c] == b[c], (c, r["arrival_no"])
        for c in ("energy_mean_24h", "energy_std_24h", "energy_mean_7d", "energy_std_7d"):
            assert (r[c] is None and b[c] is None) or abs(r[c] - b[c]) < 1e-9, (c, r[c], b[c])


def reading(series, hours, no, power=1.0):
    ts = None if hours is None else T0 + timedelta(hours=hours)
    return (series, ts, no, power, 0.0, 0.0, 0.0, 0.0)


def test_slow_late_repeated_and_unstamped_rows_are_placed_or_counted(spark):
    first = [reading("s", i, i, float(i)) for i in range(10)]
    # ``slow`` is nine days behind ``s``: in order for itself, so nothing of it is late
    slow = [reading("slow", i - 216, 500 + i) for i in range(15)]
    later = [reading("s", 10 + i, 10 + i, float(10 + i)) for i in range(5)]
    late = [reading("s", 3.5, 99), later[0], later[0], reading("s", None, 98)]
    only_late = [reading("s", 1.5, 97), reading("u", None, 900)]
    got, counts, _ = run(spark, slices(spark, first, later + late + slow[:8], only_late + slow[8:]), 3)
    ids = sorted(r["arrival_no"] for r in got)
    assert ids == [*range(15), *range(500, 515)]
    assert counts == {"s": (15, 3, 2), "slow": (15, 0, 0), "u": (0, 1, 0)}
    last = max((r for r in got if r["series_id"] == "s"), key=lambda r: r["arrival_no"])
    assert last["energy_lag_1"] == 13.0 and last["late_rows"] == 2


def test_scoring_stream_final_responses_equal_batch_scores(spark):
    rows = []
    for s, base in (("a", 0), ("b", 10000), ("blind", 20000)):
        rows += hourly(spark, 260, series=s, arrival_base=base, power=lambda i: round(10 + 3 * math.sin(i / 5.0) + (i % 4), 2))
    rows = [r[:6] + ((None if r[2] % 9 == 0 or r[0] == "blind" else 15.0 + r[2] % 7),) + r[7:] for r in rows]
    df = frame(spark, rows)
    models = fit_forecast_models(W.serving_features(df.where("series_id <> 'blind'")), rf_params={"numTrees": 3, "maxDepth": 3},
                                 gbt_params={"maxIter": 3, "maxDepth": 3})
    out, _, _ = run(spark, time_slices(df, 3), 3, models, ("Power_Consumption", "temperature", "humidity"))
    assert len(out) == 9  # one response per series per micro-batch
    first = {x["series_id"]: x for x in out if x["epoch"] == 0}
    assert first["a"]["status"] == "missing_lag" and first["a"]["prediction"] is None
    final = {x["series_id"]: x for x in out if x["epoch"] == 2}
    batch = {x["series_id"]: x for x in score_series(df, models, mode="impute").collect()}
    # a series without any temperature neither fails the others nor gets a score, in batch and stream alike
    assert final["blind"]["status"] == batch["blind"]["status"] == "invalid_input" and batch["blind"]["prediction"] is None
    for s in ("a", "b"):
        assert final[s]["status"] == batch[s]["status"] == "scored"
        for c in ("rf_pred", "gbt_pred", "seq_pred", "prediction"):
            assert abs(final[s][c] - batch[s][c]) < 1e-6, (s, c, final[s][c], batch[s][c])


def test_repeats_are_told_from_late_rows(spark):
    """A row that comes again is a repeat, whether it was placed or late the first time; rows without an arrival number never are."""
    first = [reading("s", i, i, float(i)) for i in range(5, 15)]
    second = [reading("s", 14, 14), reading("s", 1, 900), reading("s", 15, 15), reading("s", 15, 15), reading("s", 16, None), reading("s", 16, None)]
    third = [reading("s", 1, 900), reading("s", 20, 5), reading("s", 2, 901), reading("s", 21, None)]
    got, counts, _ = run(spark, slices(spark, first, second, third), 3)
    assert counts == {"s": (14, 2, 4)}
    assert sorted(r["arrival_no"] for r in got if r["arrival_no"] is not None) == [*range(5, 16)]


def test_one_run_over_many_files_equals_restarts(spark):
    """Micro-batches of one run and of runs that go on from the checkpoint place the same rows and count alike."""
    df = frame(spark, hourly(spark, 120, power=lambda i: float(i % 7)))
    again, counts, _ = run(spark, time_slices(df, 4), 4)
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = time_slices(df, 4).select("series_id", "ts", "arrival_no", "Power_Consumption", "_slice")
    for k in range(4):
        rows.where(f"_slice = {k}").drop("_slice").coalesce(1).write.mode("append").parquet(f"{base}/in")
    run_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", rows.drop("_slice").schema, max_files_per_trigger=1)
    once = spark.read.parquet(f"{base}/out").collect()
    assert {r["epoch"] for r in once} == {0, 1, 2, 3} and counts["s"] == (120, 0, 0)
    assert tuple(stream_counts(spark, f"{base}/ckpt").first()) == ("s", 120, 0, 0)
    assert sorted(map(repr, once)) == sorted(map(repr, again))


def test_seen_numbers_are_forgotten_in_time():
    import pandas as pd

    numbers = pd.Series([5, 5, BLOCK + 1, -3, None], dtype="Int64")
    seen = Seen([], [], [], now=1000)
    assert seen.fresh(numbers).tolist() == [True, False, True, True, True]
    assert seen.fresh(numbers).tolist() == [False, False, False, False, True]
    block, bits, touched = seen.stored()
    assert sorted(block) == [-1, 0, 1] and set(touched) == {1000}
    soon = Seen(block, bits, touched, now=999 + SEEN_TTL_MS)
    assert soon.fresh(pd.Series([5, 6], dtype="Int64")).tolist() == [False, True]
    late = Seen(*soon.stored(), now=1001 + SEEN_TTL_MS)  # block 0 was touched again, the others were not
    assert late.fresh(pd.Series([5, BLOCK + 1], dtype="Int64")).tolist() == [False, True]


def test_a_series_of_few_rows_keeps_a_small_state():
    """Few deliveries are held as numbers (2 bytes each, not a bitmap of 2 kB a block), many as a bitmap; both say the same."""
    import pandas as pd

    seen, spread = Seen([], [], [], now=1), list(range(0, 100_000, 7000))
    assert seen.fresh(pd.Series(spread, dtype="Int64")).all()
    assert sum(map(len, seen.stored()[1])) == 2 * len(spread)
    many = list(range(0, BLOCK, 3))
    assert seen.fresh(pd.Series(many, dtype="Int64")).tolist() == [k not in spread for k in many]
    assert len(dict(zip(*seen.stored()[:2]))[0]) == BLOCK // 8
    again = Seen(*seen.stored(), now=2)
    assert not again.fresh(pd.Series(spread + many, dtype="Int64")).any() and again.fresh(pd.Series([1], dtype="Int64")).all()


def test_a_group_gives_out_one_frame_per_chunk():
    """Stored rows, placed rows and totals of a small series come out together: a frame costs more than its rows."""
    import pandas as pd

    from wattlane.streaming.keyed import STATE, advance

    class State:
        exists, get, getCurrentProcessingTimeMs = False, None, lambda self: 1

        def update(self, value):
            self.exists, self.get = True, value

    def chunk(*numbers):
        return pd.DataFrame({"micros": [10 * k for k in numbers], "arrival_no": list(numbers), "Power_Consumption": [1.0 * k for k in numbers],
                             "temperature": [None if k % 2 else 2.0 for k in numbers], "humidity": [3.0] * len(numbers)})

    state = State()
    first = list(advance(("s",), iter([chunk(2, 1)]), state))
    assert [f.kind.tolist() for f in first] == [[1, 1, 2]] and len(state.get) == len(STATE.fields)
    out = list(advance(("s",), iter([chunk(3, 2), chunk(4, 0)]), state))
    assert [f.kind.tolist() for f in out] == [[0, 0, 1], [1, 2]]
    assert out[0].arrival_no.tolist() == [1, 2, 3] and out[1].arrival_no.tolist()[0] == 4
    total = out[1].iloc[-1]
    assert (total.n_seen, total.late_rows, total.repeated_rows, total.t_cnt, total.t_sum, total.h_sum) == (4, 1, 1, 2, 4.0, 12.0)


@pytest.mark.parametrize("names", [("a", "b", None), ("a",)])
def test_series_that_share_a_state_are_placed_as_if_alone(names):
    """A bucket of series gives out one frame a chunk, and each of its series what it gives out alone."""
    import pandas as pd

    from wattlane.streaming.keyed import TOTALS, advance

    class State:
        exists, get, getCurrentProcessingTimeMs = False, None, lambda self: 1

        def update(self, value):
            self.exists, self.get = True, value

    def chunk(*rows):
        series, hours, numbers = zip(*rows)
        return pd.DataFrame({"series_id": pd.Series(series, dtype=object), "micros": pd.Series(hours, dtype="Int64"),
                             "arrival_no": pd.Series(numbers, dtype="Int64"), "Power_Consumption": [1.0 * (n or 0) for n in numbers],
                             "temperature": [None if (n or 0) % 3 else 2.0 for n in numbers], "humidity": [3.0] * len(numbers)})

    batches = [[[(s, h, h) for h in range(k, k + 5) for s in names] for k in (0, 5)],
               [[("a", 3, 30), ("a", 9, 9), ("a", 10, 10), ("a", 10, 10), ("a", None, 11), ("a", 12, None)], [("a", 10, 10), ("a", 13, BLOCK * 3)]],
               [[(s, 20, 20) for s in names] + [("a", 13, BLOCK * 3), ("new", 1, 1)]]]

    def run_all(wanted):
        state, out = State(), []
        for batch in batches:
            chunks = [c for c in ([r for r in rows if r[0] in wanted] for rows in batch) if c]
            if chunks:
                frames = list(advance((7,), iter([chunk(*c) for c in chunks]), state))
                assert len(frames) <= len(chunks)
                out += [(len(out), *r) for r in pd.concat(frames).astype(object).where(lambda f: f.notna(), None).itertuples(index=False)]
        return out

    everything = (*names, "new")
    together = run_all(everything)
    for s in everything:
        mine = [r[1:] for r in together if r[1] == s]
        assert sorted(map(repr, mine)) == sorted(repr(r[1:]) for r in run_all((s,))) and mine
    last = [r for r in together if r[1] == "a" and r[2] == TOTALS][-1]
    assert last[8:11] == (13 + 1, 2, 4)  # placed, late, repeated


def test_streams_of_few_and_many_buckets_agree(spark):
    rows = [r for k in range(7) for r in hourly(spark, 30 + k, series=f"s{k}", arrival_base=1000 * k, power=lambda i: float(i % 7))]
    rows += hourly(spark, 40, series=None, arrival_base=9000)
    sliced = time_slices(frame(spark, rows), 3)
    some = [run(spark, sliced, 3, buckets=b)[:2] for b in (2, 2048)]
    assert some[0][1] == {**{f"s{k}": (30 + k, 0, 0) for k in range(7)}, None: (40, 0, 0)}
    assert len(some[0][0]) == len(rows)
    for out, counts in some[1:]:
        assert counts == some[0][1] and sorted(map(repr, out)) == sorted(map(repr, some[0][0]))
