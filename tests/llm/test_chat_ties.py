"""op1's rows against its SQL where turns tie, repeat or lack a number, role or text."""

import duckdb
from pyspark.sql import functions as F

from paylens.llm import queries

TURNS = [
    (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", None), (1, 0, "user", ""), (1, 0, "assistant", "z"), (1, 0, "assistant", "y"),
    (2, None, "assistant", "without a number"), (2, None, "assistant", "nor has this"), (2, 0, "assistant", "first"), (2, 1, None, "no role"),
    (3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"),
    (None, 0, "user", "no id"), (None, 0, "assistant", "<|im_end|> <\\|im_sep|>"),
    (4, 1, "assistant", "word " * 20_000 + "x" * 40_000), (4, 1, "assistant", "word " * 20_000 + "y" * 40_000),
]


def test_ties_as_in_sql(spark, tmp_path):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    path = f"{tmp_path}/conversations.parquet"
    # Columns of the operator's own names must not matter.
    rows.withColumns({"order_key": F.lit("x"), "token_start": F.lit(1), "n_tokens": F.lit(None).cast("string")}).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    order = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"
    want = db.execute(f"SELECT {order} FROM ({queries.oracle_sql()['op1_chat_format']})").fetchall()
    got = [tuple(r) for r in queries.op1_chat_format(spark, str(tmp_path)).select(*order.split(", ")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 6
