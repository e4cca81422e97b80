"""Stored weather documents, odd lines, repeats, and the stream over a growing folder."""

from __future__ import annotations

import json
from datetime import datetime

from wattlane.operators.combine import latest_observation
from wattlane.sources import weather_documents as WD
from wattlane.sources.weather import WEATHER_SCHEMA


def doc(kind="conditions", location="a", obs_id=1, at="2024-01-05T10:00:00", status=200, body=None, **current):
    if body is None:
        body = {"current": current} if kind == "conditions" else {"address": current}
    return json.dumps({"kind": kind, "location": location, "obs_id": obs_id, "at": at, "status": status, "body": body})


def parsed(spark, lines):
    return WD.parse_documents(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_reasons(spark):
    good = doc(temperature_2m=1)
    cases = {
        "invalid_json": [good[:-1], good + " x", good + good, f"[{good}]", "12", "null", "{", "x" * 100_000],
        "no_key": [doc(kind="forecast"), doc(location=None), doc(obs_id="x"), doc(at="soon"), doc(at=None), "{}", '{"kind": ["conditions"]}'],
        "failed": [doc(status=500), doc(status=None), doc(status=199), doc(body="gone"), '{"kind": "place", "location": "a", "obs_id": 1, "at": "2024-01-05", "status": 200}'],
        None: [good, "  " + good + " ", doc(body={}), doc(kind="place"), doc(body={"current": 5})],
    }
    lines = {x: reason for reason, group in cases.items() for x in group}
    got = parsed(spark, [*lines, "", "   ", None])
    assert {r.line: r.reason for r in WD.quarantined(got).collect()} == {x: reason for x, reason in lines.items() if reason}
    assert got.where("reason is null").count() == len(cases[None])


def test_fields_of_other_types_are_null(spark):
    lines = [doc(obs_id=1, temperature_2m="3.5", relative_humidity_2m=[1], wind_speed_10m=True, weather_code="61"),
             doc(obs_id=2, temperature_2m={"a": 1}, relative_humidity_2m=81, wind_speed_10m=None, weather_code=3.0),
             doc(obs_id="3", temperature_2m="", weather_code=2.5)]
    got = {r.obs_id: (r.temp, r.humidity, r.wind_speed, r.weather_code) for r in WD.observations(parsed(spark, lines)).collect()}
    assert got == {1: (3.5, None, None, 61), 2: (None, 81.0, None, 3), 3: (None, None, None, None)}


def test_the_newest_delivery_and_its_place(spark):
    lines = [doc(temperature_2m=1, at="2024-01-05T09:00:00"), doc(temperature_2m=2), doc(temperature_2m=2), doc(temperature_2m=0.5),
             doc("place", town="Old", city="X", at="2024-01-05T08:00:00"), doc("place", town="Ely"), doc("place", obs_id=9, town="Alone"),
             doc(obs_id=2, location="b", temperature_2m=7, at="2024-01-05T11:00:00"), doc(obs_id=1, location="b", temperature_2m=6)]
    out = WD.observations(parsed(spark, lines))
    assert out.columns == WEATHER_SCHEMA.names and [f.dataType for f in out.schema] == [f.dataType for f in WEATHER_SCHEMA]
    got = {(r.location, r.obs_id): (r.ts, r.temp, r.city, r.town) for r in out.collect()}
    ten = datetime(2024, 1, 5, 10)
    assert got == {("a", 1): (ten, 2.0, None, "Ely"), ("b", 1): (ten, 6.0, None, None), ("b", 2): (datetime(2024, 1, 5, 11), 7.0, None, None)}
    assert {r.location: r.temp for r in latest_observation(out).collect()} == {"a": 2.0, "b": 7.0}


def test_an_empty_folder_line_table(spark):
    assert WD.observations(parsed(spark, [])).collect() == []


def test_one_shuffle_and_no_join(spark):
    plan = WD.observations(parsed(spark, [doc()]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_stream_counts_every_file_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    folder.mkdir()

    def run():
        WD.follow_weather_documents(spark, str(folder), out, checkpoint, max_files=2).awaitTermination()
        return spark.read.parquet(out)

    for i in range(5):
        (folder / f"{i}.json").write_text("\n".join([doc(obs_id=i, temperature_2m=i), doc("place", obs_id=i + 1, town=f"t{i + 1}"), "junk"]))
    assert run().count() == 15
    assert run().count() == 15  # nothing new
    (folder / "0-late.json").write_text(doc("place", obs_id=0, town="t0") + "\n" + doc(obs_id=1, temperature_2m=-1, at="2024-01-05T12:00:00"))
    taken = run()
    assert taken.count() == 17 and WD.quarantined(taken).count() == 5
    got = {r.obs_id: (r.temp, r.town) for r in WD.observations(taken).collect()}
    assert got == {0: (0.0, "t0"), 1: (-1.0, "t1"), **{i: (float(i), f"t{i}") for i in (2, 3, 4)}}
