import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    """Tables of the smallest data folder, by name."""
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, blanks, repeats, ties, a very long text, other scripts and columns of clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "alpha beta gamma delta epsilon zeta"), (7, long), (8, long + " end"),
        (9, "été ÉTÉ İstanbul 漢字 😀 a\u00a0b"), (None, "alpha beta gamma delta epsilon zeta"), (10, "same row"), (10, "same row"), (11, "<|endoftext|> don't \u0085 x"),
    ]
    return spark.createDataFrame([(*r, 0.5, 7, "x") for r in rows], "doc_id bigint, text string, score double, shard int, _text string")


@pytest.fixture(scope="session")
def broken(odd):
    """``odd`` with texts that aren't valid UTF-8: beside words, inside one, alone, and twice."""
    bad = odd.sparkSession.sql("""
        select * from values (20L, cast(X'616C706861FFFE206265746120E28220' as string)), (21L, cast(X'FF' as string)), (22L, cast(X'C3' as string)),
            (23L, cast(X'616C706861FFFE206265746120E28220' as string)), (cast(null as bigint), cast(X'FFFE' as string)) as t(doc_id, text)""")
    return odd.unionByName(bad.selectExpr("doc_id", "text", "0.5D score", "7 shard", "'x' _text"))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
