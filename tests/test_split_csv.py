"""Parallel CSV against the plain multi-line reader."""

import random

import pytest
from pyspark.sql import types as T

from colloquy.sources import split_csv as sc
from colloquy.sources import tables as tb

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("flag", T.BooleanType()), T.StructField("at", T.TimestampType())])


def plain(spark, path, schema=SCHEMA):
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"')
            .option("escape", '"').csv(path))


@pytest.fixture
def small_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(keys, (str(n), "1"), strict=True)]
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n", last=True):
    def field(x):
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in '",\n\r') else x
    lines = ["id,text,flag,at", *(",".join(map(field, r)) for r in rows)]
    path.write_bytes((end.join(lines) + (end if last else "")).encode())


def texts(seed):
    rnd = random.Random(seed)
    words = ["a", '"', '""', "\n", "\n\n", "x,y", "é😀", " ", "", 'say "hi"\nand go', "\r\n", "b" * 90, "\n" * 40]
    return [(str(i), "".join(rnd.choices(words, k=rnd.randint(0, 6))), rnd.choice(["true", "false", ""]),
             rnd.choice(["2020-01-02 03:04:05", ""])) for i in range(40)]


@pytest.mark.parametrize("size", [37, 200, 1 << 20])
@pytest.mark.parametrize("end,last", [("\n", True), ("\n", False), ("\r\n", True)])
def test_same_rows_as_the_multi_line_reader(spark, tmp_path, small_ranges, size, end, last):
    write(tmp_path / "a.csv", texts(size), end, last)
    write(tmp_path / "b.csv", texts(size + 1)[:7], end, last)
    small_ranges(size)
    got = sc.read_split_csv(spark, str(tmp_path), SCHEMA)
    want = plain(spark, str(tmp_path))
    assert got.schema == want.schema
    # In files with \r\n the plain reader turns \r\n inside fields into \n; here fields stay as written.
    rows = [[repr(r).replace("\\r\\n", "\\n" if end == "\r\n" else "\\r\\n") for r in df.collect()]
            for df in (got, want)]
    assert sorted(rows[0]) == sorted(rows[1]) and len(rows[0]) == 47


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    write(tmp_path / "a.csv", texts(5))
    small_ranges(256)
    assert sc.csv_records(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10
    assert plain(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() == 1


def test_blank_lines_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text,flag,at\n\n1,x,true,\n\n\n2,\"\n\",,\n")
    (tmp_path / "b.csv").write_text("id,text,flag,at\n")
    (tmp_path / "c.csv").write_text("")
    got = sc.read_split_csv(spark, str(tmp_path), SCHEMA).select("id", "text").collect()
    assert sorted(map(tuple, got)) == [(1, "x"), (2, "\n")]


def test_readers_use_it(spark, tmp_path, small_ranges):
    rows = spark.createDataFrame([(str(i), "u", True, None, f'line "{i}"\n\nend', None, None) for i in range(50)],
                                 "tweet_id string, author_id string, inbound boolean, created_at string, text string, "
                                 "response_tweet_id string, in_response_to_tweet_id string")
    rows.coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "t"))
    small_ranges(64)
    got = tb.read_tweets_csv(spark, str(tmp_path / "t"))
    assert sorted(r.text for r in got.collect()) == sorted(f'line "{i}"\n\nend' for i in range(50))
