from pyspark.sql import functions as F

from divspark.operators.parse import parse_responses
from divspark.streaming import parse_response_stream, write_parsed_stream
from tests.conftest import rows

SCHEMA = "run string, label int, seed string, response string"


def test_stream_matches_batch(spark, tmp_path):
    src, sink = tmp_path / "src", tmp_path / "sink"
    batches = [[("r1", 0, "s", "[INST] p [/INST] h\n1. One\n2. Two"), ("r1", 1, "t", "[INST] q [/INST] h\n1. One")],
               [("r1", 0, "s", "[INST] p [/INST] h\n1. one\n3. Three"), ("r2", 0, "s", "[INST] p [/INST] h\n1. x")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).write.mode("append").parquet(str(src))
    stream = parse_response_stream(spark, str(src), SCHEMA, "llama", ["run"])
    q = write_parsed_stream(stream, str(sink), ["run"])
    q.awaitTermination(120)
    got = rows(spark.read.parquet(str(sink)), "run", "label", "seed", "text")
    all_rows = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    expect = rows(parse_responses(all_rows, "llama", ["run"]), "run", "label", "seed", "text")
    assert got == expect
    # a second sink is filled too; a second run of the first adds nothing
    other = write_parsed_stream(parse_response_stream(spark, str(src), SCHEMA, "llama", ["run"]), str(tmp_path / "b"), ["run"])
    other.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "b")), "run", "label", "seed", "text") == expect
    write_parsed_stream(parse_response_stream(spark, str(src), SCHEMA, "llama", ["run"]), str(sink), ["run"]).awaitTermination(120)
    assert rows(spark.read.parquet(str(sink)), "run", "label", "seed", "text") == expect
