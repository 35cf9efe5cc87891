"""The text reader against pandas, over as many splits as there are, and as one."""

import random

import pandas as pd
import pytest

from veilspark.sources import files, records


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "96")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def same_as_pandas(spark, path, sep=","):
    want = pd.read_csv(path, sep=sep, dtype=str, index_col=False)
    got = files.scan(spark, path).orderBy(files.ORDINAL).toPandas().drop(columns=files.ORDINAL)
    assert got.columns.tolist() == want.columns.tolist()
    clean = lambda d: [[None if pd.isna(x) else x for x in r] for r in d.astype(object).values.tolist()]
    assert clean(got) == clean(want)
    return len(want)


def put(tmp_path, name, text):
    path = f"{tmp_path}/{name}"
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


CASES = {
    "inches": 'id,what\n1,5" pipe\n2,rod\n3,bolt\n4,7" pipe\n5,nut\n',
    "breaks": 'id,what\n1,"a\n\nb"\n2,"c ""d"", e"\n3,x\n',
    "after_quote": 'id,what\n1,"x"y"z\n2,"x"  \n"3"," ""q"\n',
    "carriage": 'id,what\r\n1,"a\r\nb"\r\n2,c\r3,d\r\n\r\n4," e"\r\n',
    "blank": 'id,what\n \t\n1,\n\n""," "\n2\n',
    "hash": 'id,what\n#3,x\n4,"#y"\n',
}


@pytest.mark.parametrize("name", CASES)
def test_quotes_as_pandas_reads_them(spark, tmp_path, name):
    assert same_as_pandas(spark, put(tmp_path, f"{name}.csv", CASES[name]))


def test_tabs(spark, tmp_path):
    assert same_as_pandas(spark, put(tmp_path, "t.tsv", 'id\twhat\n1\t5" pipe\n2\t"a\tb\nc"\n \n\t\n'), "\t") == 3


def made(rng, n, end="\n"):
    """Records of all kinds; a quoted cell may hold anything, an unquoted one stray quotes."""
    inner = ["a", " ", ",", "\n", '""', "5", "#", "\n\n", "longer words here"]
    plain = ["b", '"', " ", "7", "#", "'"]

    def cell():
        kind = rng.random()
        if kind < 0.35:
            return '"' + "".join(rng.choice(inner) for _ in range(rng.randrange(12))) + '"' + ("" if rng.random() < 0.8 else 'tail"s')
        return rng.choice("xyz") + "".join(rng.choice(plain) for _ in range(rng.randrange(6)))

    return "id,one,two" + end + "".join(f"{i},{cell()},{cell()}{end}" for i in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_made_files_over_many_splits(spark, tmp_path, small_splits, seed):
    path = put(tmp_path, f"made{seed}.csv", made(random.Random(seed), 120, "\r\n" if seed == 2 else "\n"))
    found = records.composed(records.effects(records.lines_of(spark, path), ",", 1))
    assert found.filter("begins").count() > 5 < found.filter("NOT begins").count()
    assert same_as_pandas(spark, path) == 120


def test_a_cell_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i} of a long, long cell" for i in range(60))
    path = put(tmp_path, "long.csv", f'# head\nid,note\n1,"{long}"\n2,after\n3,"{long} ""quoted"""\n')
    got = {r.id: r.note for r in files.scan(spark, path).collect()}
    assert got == {"1": long, "2": "after", "3": f'{long} "quoted"'}


def test_a_folder_of_files(spark, tmp_path):
    for i in range(5):
        put(tmp_path, f"part-{i}.csv", f'# one: said\nid,one\n{i},"x\n{i}"\n{i + 10},5" y\n')
    got = files.scan(spark, str(tmp_path))
    assert sorted((r.id, r.one) for r in got.collect()) == sorted([(str(i), f"x\n{i}") for i in range(5)] + [(str(i + 10), '5" y') for i in range(5)])
    assert got.schema["one"].metadata == {"description": "said"}


def test_an_open_quote_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="ends inside quotes"):
        files.scan(spark, put(tmp_path, "open.csv", 'id,a\n1,"x\n2,y\n'))
    assert files.scan(spark, put(tmp_path, "empty.csv", "id,a\n")).count() == 0
