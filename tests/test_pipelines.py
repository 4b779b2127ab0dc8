import json
import random

import pytest
from pyspark.sql import functions as F

from veilframe import cli
from veilframe.config import MEDICAL_COUNT, MEDICAL_MEAN, Config, KAnonymity, Privacy
from veilframe.operators import privacy, transforms
from veilframe.pipelines import anonymize
from veilframe.sources import json_arrays, readers, sinks
from veilframe.streaming import accumulate, release


def observations(n=400):
    for i in range(n):
        yield {"id": i, "license_plate": f"p{i % 9}", "trip_id": f"t{i}", "speed": float(i % 70), "observationDateTime": f"2021-03-0{1 + i % 3}T{i % 24:02d}:10:00+05:30", "location": {"type": "Point", "coordinates": [77.5, 12.9 + (i % 2) / 100]}}


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder, rows = tmp_path_factory.mktemp("raw"), list(observations())
    (folder / "a.json").write_text(json.dumps(rows[:200]))
    (folder / "b.json").write_text(json.dumps([{k: v for k, v in r.items() if k != "trip_id"} if i % 2 else r for i, r in enumerate(rows[200:])]))
    return readers.read(spark, [str(folder / "a.json"), str(folder / "b.json")], with_file=True)


SPATIO = Config(
    data_type="spatioTemporal", operations=("suppress", "pseudonymize", "dp"), suppress=("id", "location.type"), pseudonymize=("license_plate", "trip_id"),
    privacy=Privacy(query="mean", output_attribute="speed", aggregate=("HAT",), least=0.0, most=65.0), events_per_day=1)


def test_reader_flattens(raw):
    assert {"location.coordinates", "location.type", "file"} <= set(raw.columns) and raw.count() == 400


def test_spatiotemporal(raw):
    out = anonymize.run(raw, SPATIO, privacy.keyed("s", "HAT"))
    assert {"id", "location.type", "license_plate"}.isdisjoint(out["anonymized"].columns)
    noisy = out["noisy"].collect()
    assert noisy and all(9 <= int(r.HAT.split()[0]) <= 20 for r in noisy)
    assert out["errors"].count() == 290 and out["errors_by_tile"].count() == 290 * len(noisy)
    counts = anonymize.run(raw, Config(data_type="spatioTemporal", operations=("dp",), privacy=Privacy(query="count", output_attribute="speed", aggregate=("HAT",)), events_per_day=1))
    assert set(counts) == {"errors", "noisy"}


def test_stream_gives_the_batch_state(spark, raw, tmp_path):
    raw.drop("file").repartition(3).write.json(str(tmp_path / "in"))
    schema = spark.read.json(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = accumulate.accumulated(stream, SPATIO).writeStream.outputMode("complete").format("memory").queryName("state").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("state").collect())
    assert got == sorted(tuple(r) for r in accumulate.accumulated(raw.drop("file"), SPATIO).collect())


def test_stream_clamps_and_cuts_as_the_batch(spark, raw, tmp_path):
    from dataclasses import replace

    config = replace(SPATIO, privacy=replace(SPATIO.privacy, clamp=True, least=10.0, most=30.0))
    raw.drop("file").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.json(str(tmp_path / "in")).schema).json(str(tmp_path / "in"))
    accumulate.accumulated(stream, config).writeStream.outputMode("complete").format("memory").queryName("clamped").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.HAT, r.Date, r.license_plate): r.output_attribute_sum for r in spark.table("clamped").collect()}
    assert got == {(r.HAT, r.Date, r.license_plate): r.output_attribute_sum for r in anonymize.grain(raw.drop("file"), replace(config, events_per_day=0)).collect()}


def test_release_from_a_stream(spark, tmp_path):
    import shutil
    from dataclasses import replace

    config = replace(SPATIO, events_per_day=1, privacy=replace(SPATIO.privacy, epsilon=0.5))
    (tmp_path / "in").mkdir()
    days = [[r for r in observations(300) if r["observationDateTime"].startswith(f"2021-03-0{d}")] for d in (1, 2, 3)]
    days.append([{**days[0][0], "observationDateTime": "2021-03-09T12:00:00+05:30"}])
    put = lambda i: (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in days[i]))
    for i in (0, 1, 2):
        put(i)
    schema = spark.read.json(str(tmp_path / "in")).schema
    out, ledger, state = (str(tmp_path / x) for x in ("out", "ledger", "state"))

    def run(name="mean", budget=1.0, checkpoint=state, **other):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = release.start(readers.flatten(stream), replace(config, **other), b"key", name, out, ledger, checkpoint, budget, availableNow=True)
        query.awaitTermination(180)
        return query

    published = lambda: {w.name: sorted(x.read_text() for x in w.glob("*.json")) for w in (tmp_path / "out").iterdir()} if (tmp_path / "out").exists() else {}
    entries = lambda: sorted(tuple(r) for r in release.spent(spark, ledger).collect())
    run()
    first = published()
    assert set(first) == {"window=2021-03-01T00-00-00", "window=2021-03-02T00-00-00"} and all(any(v) for v in first.values())
    assert entries() == [(f"2021-03-0{d}T00-00-00", "mean", 0.5) for d in (1, 2)]
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    for n in (last - 1, last):  # as if it had failed before its last batches were committed
        for p in (tmp_path / "state" / "commits").glob(f"*{n}*"):
            p.unlink()
    shutil.rmtree(tmp_path / "out")
    run()
    again = published()
    assert again and all(again[w] == first[w] for w in again) and len(entries()) == 2
    put(3)
    run()
    assert "window=2021-03-03T00-00-00" in published() and len(entries()) == 3
    rows = spark.read.json(out)
    assert rows.select("window", "HAT").distinct().count() == rows.count() and all(9 <= int(r.HAT.split()[0]) <= 20 for r in rows.collect())
    run("other", checkpoint=str(tmp_path / "second"))  # the budget allows two halves
    assert len(entries()) == 6
    with pytest.raises(Exception, match="are spent"):
        run("third", checkpoint=str(tmp_path / "third"))
    assert len(entries()) == 6


def test_ledger(spark, tmp_path):
    ledger = str(tmp_path / "l")
    release.spend(spark, ledger, "w", "a", 0.4, 1.0)
    release.spend(spark, ledger, "w", "a", 0.4, 1.0)
    with pytest.raises(release.OverBudget):
        release.spend(spark, ledger, "w", "a", 0.3, 1.0)
    release.spend(spark, ledger, "w", "b", 0.6, 1.0)
    with pytest.raises(release.OverBudget):
        release.spend(spark, ledger, "w", "c", 0.01, 1.0)
    release.spend(spark, ledger, "v", "c", 1.0, 1.0)
    assert release.spent(spark, ledger).count() == 3


def test_secrets_and_hexagons_of_the_configuration(spark, raw):
    from dataclasses import replace

    config = replace(SPATIO, cells="hex", pseudonym_key="p", pseudonymize=("license_plate", "trip_id", "id"), suppress=("location.type",), noise_key="n")
    out = [{r.HAT: r["noisy mean of speed"] for r in anonymize.run(raw, config)["noisy"].collect()} for _ in range(2)]
    assert out[0] and out[0] == out[1] and all(h.split(" ")[1].startswith("7x") for h in out[0])
    assert {r.HAT: r["noisy mean of speed"] for r in anonymize.run(raw, replace(config, noise_key="m"))["noisy"].collect()} != out[0]
    hashed = anonymize.run(raw, config)["anonymized"]
    assert {"license_plate", "trip_id", "id"}.isdisjoint(hashed.columns) and hashed.select("Hashed Value").distinct().count() > 300


def test_medical(spark):
    rows = [(f"n{i}", i, i % 60, "FM"[i % 2], i % 5, "Positive" if i % 3 else "Negative", i % 70) for i in range(600)]
    df = spark.createDataFrame(rows, "`Name` string, `Patient ID` int, `Age` int, `Gender` string, `PIN Code` int, `Test Result` string, `Days To Negative` int")
    config = Config(data_type="medical", operations=("k_anonymize", "dp", "pseudonymize"), pseudonymize=("Name", "Patient ID"), k_anonymize=KAnonymity(k=20), privacy=MEDICAL_MEAN)
    out = anonymize.run(df, config)
    assert "Age" not in out["k_anonymous"].columns and out["k_anonymous"].count() == 600
    assert {r.Gender for r in out["noisy"].collect()} == {"F", "M"} and out["errors"].count() == 100
    counts = anonymize.run(df, Config(data_type="medical", operations=("dp",), privacy=MEDICAL_COUNT), lambda _: F.lit(0.5))["noisy"].collect()
    assert {r["PIN Code"]: r["noisy count of Test Result"] for r in counts} == {p: float(sum(1 for r in rows if r[4] == p and r[5] == "Positive")) for p in range(5)}


@pytest.mark.parametrize("bad", [
    {"data_type": "x", "operations": ["dp"]}, {"data_type": "medical", "operations": []}, {"data_type": "medical", "operations": ["suppress"]},
    {"data_type": "medical", "operations": ["dp"], "privacy": {"query": "median", "output_attribute": "a", "aggregate": ["b"]}},
    {"data_type": "spatioTemporal", "operations": ["k_anonymize"], "k_anonymize": {"k": 3}}])
def test_configuration_is_checked(bad):
    with pytest.raises(ValueError):
        Config.of(bad)


def test_configuration_from_a_file(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"data_type": "medical", "operations": ["suppress"], "suppress": ["Address"]}))
    assert Config.load(str(path)).suppress == ("Address",)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1 / 3, None), ("b", 2.0, 1)], "k string, x double, n int")
    sinks.write_lines(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    sinks.write_records(df, str(tmp_path / "r.json"))
    sinks.write_by_row(df, str(tmp_path / "w.json"))
    sinks.write_by_key(df, "k", str(tmp_path / "d" / "k.json"))
    assert json.loads((tmp_path / "r.json").read_text())[0] == {"k": "a", "x": 0.3333333333, "n": None}
    assert json.loads((tmp_path / "w.json").read_text())["1"]["k"] == "b"
    assert json.loads((tmp_path / "d" / "k.json").read_text())["b"] == {"x": 2.0, "n": 1}
    table = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.1, 1.0)], "HAT string, epsilon double, b double")
    sinks.write_table(table, "HAT", str(tmp_path / "t.json"))
    assert json.loads((tmp_path / "t.json").read_text()) == {"a": {"1.0": 2.0, "1.1": 1.0}}


def test_documents_of_many_rows_are_written_by_the_tasks(spark, tmp_path):
    n = 300_000
    rows = spark.range(0, n, numPartitions=7).select("id", F.when(F.col("id") % 3 == 0, F.lit('a "quoted" é')).alias("t"))
    sinks.write_by_row(rows, str(tmp_path / "k" / "rows.json"))
    got = json.loads((tmp_path / "k" / "rows.json").read_text())
    assert list(got) == [str(i) for i in range(n)] and got["3"] == {"id": 3, "t": 'a "quoted" é'} and got["4"] == {"id": 4, "t": None}
    assert [p.name for p in (tmp_path / "k").iterdir() if not p.name.endswith(".crc")] == ["rows.json"]
    sinks.write_records(rows.limit(0), str(tmp_path / "none.json"))
    sinks.write_by_row(rows.filter("id in (5, 299999)"), str(tmp_path / "two.json"))  # most parts are empty
    assert json.loads((tmp_path / "none.json").read_text()) == [] and json.loads((tmp_path / "two.json").read_text()) == {"0": {"id": 5, "t": None}, "1": {"id": 299999, "t": None}}
    table = spark.createDataFrame([(None, 1.0), ("b", None), ('"', 2.0)], "k string, x double")
    sinks.write_by_key(table, "k", str(tmp_path / "one.json"))
    assert json.loads((tmp_path / "one.json").read_text()) == {'"': 2.0, "b": None, "None": 1.0}
    wide = spark.range(600).select(F.concat(F.lit("9 t"), "id").alias("HAT"), F.explode(F.expr("sequence(1, 290)")).alias("i")).select("HAT", (F.col("i") / 10).alias("epsilon"), F.lit(0.5).alias("b"))
    sinks.write_table(wide, "HAT", str(tmp_path / "wide.json"))
    got = json.loads((tmp_path / "wide.json").read_text())
    assert len(got) == 600 and list(got["9 t7"])[:3] == ["0.1", "0.2", "0.3"] and len(got["9 t7"]) == 290


def hostile(rnd, depth):
    k = rnd.random()
    if k < 0.2 and depth:
        return {rnd.choice('ab}{"\\['): hostile(rnd, depth - 1) for _ in range(rnd.randint(0, 3))}
    if k < 0.4 and depth:
        return [hostile(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    return "".join(rnd.choice('ab}{][",\\é\n 😀') for _ in range(rnd.choice([0, 3, 40]))) if k < 0.8 else rnd.choice([1, 2.5, None, True])


@pytest.fixture
def tiny_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 97)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_arrays_are_read_in_ranges(spark, tmp_path, tiny_ranges):
    rnd, want = random.Random(1), []
    for i in range(6):
        made = [{"id": i * 1000 + j, "s": hostile(rnd, 2), "t": "}" * rnd.choice([0, 1, 300])} for j in range(rnd.choice([0, 1, 20]) if i else 25)]
        want += made
        (tmp_path / f"{i}.json").write_text(json.dumps(made, ensure_ascii=i % 2 == 0, indent=rnd.choice([None, 1])))
    (tmp_path / "one.json").write_text(json.dumps({"id": -1, "s": {"q": ["}"]}}))
    want.append({"id": -1, "s": {"q": ["}"]}})
    norm = lambda x: json.dumps(x, sort_keys=True)
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 40
    found = json_arrays.objects(spark, str(tmp_path))
    assert sorted(norm(json.loads(r.value)) for r in found.collect()) == sorted(map(norm, want))


def test_ranges_and_whole_documents_agree(spark, tmp_path, tiny_ranges):
    (tmp_path / "a.json").write_text(json.dumps(list(observations(60))))
    (tmp_path / "b.json").write_text(json.dumps([{k: v for k, v in r.items() if k != "trip_id"} | {"note": "x"} for r in observations(7)]))
    whole = readers.read(spark, str(tmp_path), with_file=True)
    ranges = readers.read(spark, str(tmp_path), with_file=True, large=100)
    assert sorted(ranges.columns) == sorted(whole.columns) and dict(ranges.dtypes) == dict(whole.dtypes)
    assert sorted(map(str, ranges.select(*[f"`{c}`" for c in whole.columns]).collect())) == sorted(map(str, whole.collect()))


def test_what_is_no_array_of_objects_is_an_error(spark, tmp_path, tiny_ranges):
    for i, text in enumerate(['[1, {"a": 2}]', '[{"a": 1}, {"b": "x', '[{"a": [1, {"c": 2}', '[[{"a": 1}]]']):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(Exception, match="no object|ends within"):
            json_arrays.objects(spark, str(tmp_path / f"{i}.json")).collect()
    (tmp_path / "e.json").write_text(" [ ] ")
    assert json_arrays.objects(spark, str(tmp_path / "e.json")).count() == 0


def test_drifting_types_and_misfits(spark, tmp_path):
    for i, v in enumerate((1, 2.5, "x", {"k": 1})):
        (tmp_path / f"{i}.json").write_text(json.dumps([{"v": v, "w": i}]))
    got = {r.w: r.v for r in json_arrays.read(spark, str(tmp_path)).collect()}
    assert got == {0: "1", 1: "2.5", 2: "x", 3: '{"k":1}'}
    kept = {r.w: (r.v, r.odd) for r in json_arrays.read(spark, str(tmp_path), "v double, w int", misfits="odd").collect()}
    assert kept[0] == (1.0, None) and kept[1] == (2.5, None) and all(kept[i][0] is None and '"v"' in kept[i][1] for i in (2, 3))


SECTIONS = {
    "data_type": "medical",
    "medical": {
        "suppress": ["Name"], "pseudonymize": ["Patient ID", "Phone"], "k_anonymize": {"generalize": "Age", "k": 20, "min_bin_value": 0, "max_bin_value": 61},
        "differential_privacy": {"dp_query": "mean", "dp_output_attribute": "Days To Negative", "dp_selected_output": "Positive", "dp_aggregate_attribute": "Gender", "dp_max_value_output_attribute": 40, "dp_epsilon": 0.5}},
    "spatioTemporal": {
        "suppress": ["id", "location.type"], "pseudonymize": ["license_plate", "trip_id"],
        "spatial_generalize": {"spatial_attribute": "location.coordinates", "h3_resolution": 7, "filter_attribute": "license_plate", "filter_event_occurences": 1, "filter_attribute_by": ["HAT", "Date"]},
        "temporal_generalize": {"temporal_attribute": "observationDateTime", "start_time": 10, "end_time": 12},
        "differential_privacy": {"dp_query": "mean", "dp_output_attribute": "speed", "dp_aggregate_attribute": ["HAT", "Date", "license_plate"], "dp_query_value_threshold": 60, "dp_epsilon": 1, "dp_epsilon_step": 0.5, "global_max_value": 65, "global_min_value": 5}},
}


def test_configuration_by_sections():
    medical = Config.of(SECTIONS)
    assert medical.operations == ("suppress", "pseudonymize", "k_anonymize", "dp") and medical.k_anonymize == KAnonymity("Age", 20, 0, 61)
    assert medical.privacy == Privacy(query="mean", output_attribute="Days To Negative", aggregate=("Gender",), selected="Positive", epsilon=0.5, most=40)
    count = Config.of(SECTIONS, operations=("dp",), query="count")
    assert count.operations == ("dp",) and (count.privacy.output_attribute, count.privacy.aggregate) == ("Test Result", ("PIN Code",))
    spatio = Config.of(SECTIONS, dataset="spatioTemporal", query="count")
    assert (spatio.hours, spatio.events_per_day, spatio.privacy.query, spatio.privacy.least, spatio.privacy.most) == ((10, 12), 1, "count", 5, 65)
    beside = Config.of({"data_type": "medical", "medical": {"generalize": "Age", "k_anonymize": {"k": 5, "min_bin_value": 0, "max_bin_value": 1000}}})
    assert beside.operations == ("k_anonymize",) and beside.k_anonymize == KAnonymity("Age", 5, 0, 1000)
    with pytest.raises(ValueError):
        Config.of(SECTIONS | {"spatioTemporal": SECTIONS["spatioTemporal"] | {"differential_privacy": SECTIONS["spatioTemporal"]["differential_privacy"] | {"dp_aggregate_attribute": ["HAT"]}}}, dataset="spatioTemporal")


def test_command_line(spark, tmp_path, capsys):
    config, events = tmp_path / "c.json", tmp_path / "events.json"
    config.write_text(json.dumps(SECTIONS))
    events.write_text(json.dumps(list(observations())))
    cli.main([str(config), str(tmp_path / "out"), str(events), "--dataset", "spatioTemporal", "--documents"])
    got = {p.name: json.loads(p.read_text()) for p in (tmp_path / "out").iterdir()}
    assert set(got) == {"suppression_pseudonymization.json", "spatioTemporal_EpsVSMAEperHAT_mean.json", "spatioTemporal_EpsVSMAE_mean.json", "spatioTemporal_noisyQueryOutput_mean.json"}
    tiles = got["spatioTemporal_noisyQueryOutput_mean.json"]
    assert tiles and all(set(v) == {"mean of speed", "noisy mean of speed"} for v in tiles.values()) and set(got["spatioTemporal_EpsVSMAEperHAT_mean.json"]) == set(tiles)
    assert len(got["suppression_pseudonymization.json"]) == 400 and "anonymized: {'rows': 400}" in (said := capsys.readouterr().err) and f"'distinct HAT': {len(tiles)}" in said
    people = tmp_path / "people.jsonl"
    people.write_text("".join(json.dumps({"Name": "n", "Patient ID": i, "Phone": i, "Age": i % 60, "Gender": "FM"[i % 2], "PIN Code": i % 3, "Test Result": "Positive", "Days To Negative": i % 50}) + "\n" for i in range(600)))
    cli.main([str(config), str(tmp_path / "k"), str(people), "--format", "jsonl", "--operation", "k_anonymize", "--operation", "dp", "--query", "count", "--documents"])
    assert {p.name for p in (tmp_path / "k").iterdir()} == {"medical_k_anon_full_dataset.json", "medical_k_anon_user_counts.json", "medical_EpsVSMAE_count.json", "medical_noisyQueryOutput_count.json"}
    cli.main([str(config), str(tmp_path / "lines"), str(people), "--format", "jsonl", "--operation", "suppress"])
    assert spark.read.json(str(tmp_path / "lines" / "anonymized")).count() == 600


def test_options_of_the_private_query(spark):
    rows = [("FM"[i % 2], float(i % 70) - 10) for i in range(600)]
    df = spark.createDataFrame(rows, "Gender string, d double")
    for p in (Privacy(output_attribute="d", aggregate=("Gender",), redact_true=True, clamp=True, halved=True), Privacy(output_attribute="d", aggregate=("Gender",), draws=50, epsilon_step=5.0)):
        out = anonymize.run(df, Config(data_type="medical", operations=("dp",), privacy=p), lambda _: F.lit(0.5))
        noisy = {r["Gender"]: r["noisy mean of d"] for r in out["noisy"].collect()}
        assert ("mean of d" in out["noisy"].columns) != p.redact_true and out["errors"].count() > 0
        for g, mean in noisy.items():
            own = [min(max(v, 0), 50) if p.clamp else min(v, 50) for s, v in rows if s == g and v != 0]
            assert mean == pytest.approx(sum(own) / len(own), abs=6e-4)


def test_first_of_equal_rows_stays(spark):
    df = spark.createDataFrame([(3, "a", 1.0, [1]), (1, "a", 1.0, [2]), (2, None, None, None), (4, None, None, [9]), (None, "b", 0.0, None), (7, "b", 0.0, [3])], "n int, `k.x` string, y double, z array<int>")
    assert sorted((str(r.n), r["k.x"], r.z) for r in transforms.deduplicate(df, ["n"]).collect()) == [("1", "a", [2]), ("2", None, None), ("None", "b", None)]
