import pytest
from pyspark.sql import functions as F

from divspark.sources import csv_io as IO
from tests.conftest import rows



def test_csv_roundtrip_quotes_newlines(spark, tmp_path):
    data = [("a", 'say "hi", then\nleave', 1), ("b", "null", 2), ("b", "", 3)]
    df = spark.createDataFrame(data, "dataset string, text string, label int")
    IO.write_runs(df, str(tmp_path / "t"), ["dataset"], fmt="csv")
    back = IO.read_written(spark, str(tmp_path / "t"), "text string, label int", fmt="csv")
    got = rows(back, "dataset", "text", "label")
    assert ("a", 'say "hi", then\nleave', 1) in got and ("b", "null", 2) in got
    nulls = IO.pandas_nulls(back)
    assert rows(nulls.where(F.col("text").isNull()), "label") == [(2,), (3,)]


def test_fallback_per_run(spark, tmp_path):
    for run, name, text in [("0", "news_a.csv", "from news"), ("0", "fb_a.csv", "from fb 0"),
                            ("1", "fb_a.csv", "from fb 1")]:
        d = tmp_path / "ds" / "gpt" / run
        d.mkdir(parents=True, exist_ok=True)
        (d / name).write_text(f"text,label\n{text},1\n")
    got = IO.read_with_fallback(spark, str(tmp_path), ["news_*.csv", "fb_*.csv"])
    assert rows(got, "iteration", "text") == [(0, "from news"), (1, "from fb 1")]
    with pytest.raises(FileNotFoundError):
        IO.read_with_fallback(spark, str(tmp_path), ["none_*.csv"])


def _run_file(root, run, name, lines):
    d = root.joinpath(*run)
    d.mkdir(parents=True, exist_ok=True)
    (d / name).write_text("\n".join(lines) + "\n")


def test_edge_spaces_and_specials_survive(spark, tmp_path):
    texts = ["  lead trail  ", "\ttab\t", 'q"uo"te', "line\nbreak ", "a,b", " "]
    for run in ("r/a b", "50% + c=d", "ünï", "x"):
        df = spark.createDataFrame([(run, t) for t in texts], "dataset string, text string")
        path = str(tmp_path / str(abs(hash(run))))
        IO.write_runs(df, path, ["dataset"], fmt="csv")
        assert rows(IO.read_written(spark, path, "text string", fmt="csv"), "dataset", "text") == sorted(
            ((run, t) for t in texts), key=repr)
        got = IO.read_runs(spark, path, "*.csv", "text string", keys=["dataset"])
        assert {r["dataset"] for r in got.collect()} == {run}


def test_run_names_and_iterations_from_plain_folders(spark, tmp_path):
    for run in (("ds", "my model", "0"), ("ds+x", "m%41", "it0")):
        _run_file(tmp_path, run, "seeds.csv", ["text,label", "hello,1"])
    got = IO.read_runs(spark, str(tmp_path), "seeds.csv")
    assert rows(got, "dataset", "model", "iteration") == [("ds", "my model", 0), ("ds+x", "m%41", None)]


def test_seed_files_and_round_links(spark, tmp_path):
    for it in "01":
        run = ("atis", "gpt", it)
        _run_file(tmp_path, run, "seeds.csv", ["text,label", *[f"seed {lab} {k},{lab}" for lab in (0, 1) for k in range(6)]])
        _run_file(tmp_path, run, "fb_0_seeds.csv", ["label,text,seed", *[f"{lab},para {lab} {k},seed {lab} {k}"
                                                                        for lab in (0, 1) for k in range(6)]])
        _run_file(tmp_path, run, "fb_1_chaining.csv", ["label,text,seed", "0,again,para 0 1", "0,again,para 0 2", '1,"x, y",para 1 3'])
    keys = ["dataset", "model", "iteration"]
    seeds = IO.read_runs(spark, str(tmp_path), "seeds.csv")
    assert {r["count"] for r in seeds.groupBy(*keys, "label").count().collect()} == {6}
    r0 = IO.read_runs(spark, str(tmp_path), "fb_0_seeds.csv", IO.PARAPHRASE_SCHEMA)
    assert r0.join(seeds.withColumnRenamed("text", "seed"), [*keys, "seed", "label"], "left_anti").count() == 0
    ch = IO.read_runs(spark, str(tmp_path), "fb_1_chaining.csv", IO.PARAPHRASE_SCHEMA)
    assert ch.join(r0.select(*keys, F.col("text").alias("seed")), [*keys, "seed"], "left_anti").count() == 0
    assert ch.groupBy(*keys, "text").count().where("count > 1").count() == 2


def test_metric_log_roundtrip(spark, tmp_path):
    log = spark.createDataFrame([("atis", "mistral", 0, "hints", 1, 10, 55.5)],
                                "dataset string, model string, iteration int, method string, rep int, epoch int, acc double")
    IO.write_runs(log, str(tmp_path / "accs"))
    back = IO.read_written(spark, str(tmp_path / "accs"))
    assert rows(back, "dataset", "model", "iteration", "method", "epoch", "acc") == \
        [("atis", "mistral", 0, "hints", 10, 55.5)]


def test_reclean_before_hints(spark):
    from divspark.functions.text import clean_text
    df = spark.createDataFrame([('  "Hi," There  ',)], "t string")
    assert df.select(clean_text("t", remove_punctuation=False)).first()[0] == "hi, there"


def test_chosen_runs_open_no_other_file(spark, tmp_path):
    """S-2: plain and Hive-style directories, names with specials; the rest is not opened."""
    import shutil

    for d, m, i in (("atis", "gpt", 0), ("atis", "gpt", 1), ("fb", "gpt", 0), ("a{b},c", "x y", 2)):
        folder = tmp_path / d / m / str(i)
        folder.mkdir(parents=True)
        (folder / "seeds.csv").write_text(f"text,label\n{d} {m} {i},1\n")
    got = IO.read_runs(spark, str(tmp_path), "seeds.csv", only={"dataset": ["atis"], "iteration": [1, 7]})
    assert [r["text"] for r in got.collect()] == ["atis gpt 1"]
    assert [f.rsplit("/", 4)[1:] for f in got.inputFiles()] == [["atis", "gpt", "1", "seeds.csv"]]
    odd = IO.read_runs(spark, str(tmp_path), "seeds.csv", only={"dataset": ["a{b},c"], "model": ["x y"]})
    assert [(r["dataset"], r["model"], r["iteration"]) for r in odd.collect()] == [("a{b},c", "x y", 2)]
    none = IO.read_runs(spark, str(tmp_path), "seeds.csv", only={"dataset": ["nothing"]})
    assert none.collect() == [] and none.columns == ["text", "label", "dataset", "model", "iteration"]
    assert IO.read_runs(spark, str(tmp_path), "seeds.csv", only={"model": []}).collect() == []
    with pytest.raises(ValueError):
        IO.read_runs(spark, str(tmp_path), "seeds.csv", only={"data": ["atis"]})
    hive = str(tmp_path / "hive")
    df = spark.createDataFrame([("t", 1, "p:q", "m"), ("u", 2, None, "m"), ("v", 3, "z", "m")],
                               "text string, label int, dataset string, model string")
    IO.write_runs(df, hive, ["dataset", "model"], fmt="csv")
    part = IO.read_runs(spark, hive, "part-*.csv", keys=("dataset", "model"), only={"dataset": ["p:q", None]})
    assert sorted((r["text"], r["dataset"]) for r in part.collect()) == [("t", "p:q"), ("u", None)]
    assert len(part.inputFiles()) == 2
