"""Quotation links over a table of nested quotations, against their SQL."""

import random
from collections import Counter

import pandas as pd
from checks import connect

from lectern.llm import chat_format, queries


def conversations(count, turns, seed):
    """Conversations in which most messages quote earlier ones, quotes of quotes included, whole or line by line."""
    rng, rows = random.Random(seed), []
    for conv in range(count):
        step, texts = rng.choice([1, 3, 10 ** 9 + 7]), []
        for n in range(turns):
            own = [f"line {rng.randrange(40)} of {conv}" for _ in range(rng.randrange(1, 4))]
            if rng.random() < 0.2:
                own.insert(1, "")
            lines = []
            if texts and rng.random() < 0.8:
                quoted = rng.choice(texts[-6:]).split("\n")
                lines = ["> " + x for x in (quoted if rng.random() < 0.6 else rng.sample(quoted, 1))]
            texts.append("\n".join(lines + own))
            rows.append((conv, (n - 5) * step, rng.choice(["user", "assistant", None]), texts[-1]))
    return rows + [rows[3], (None, 1, "user", "> x"), (0, None, "user", None), (count, 9 * 10 ** 18, "user", "far"), (count, -9 * 10 ** 18, "user", "> far")]


def test_nested_quotations_equal_their_sql(spark, tmp_path):
    table = spark.createDataFrame(conversations(60, 25, 1), "conv_id bigint, turn bigint, role string, text string")
    table.coalesce(1).write.parquet(str(tmp_path / "all"))
    (tmp_path / "sql").mkdir()
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "sql" / "conversations.parquet")
    result = chat_format.link_quotations(table)
    con = connect(str(tmp_path / "sql")).execute(f"select {', '.join(result.columns)} from ({queries.CHECKS['op2_chat_quotations']})")
    rows = [tuple(r) for r in result.collect()]
    assert Counter(rows) == Counter(con.fetchall())
    got = pd.DataFrame(rows, columns=result.columns, dtype=object)
    assert (got["n_linked"] > 0).sum() > 800 and got["reply_path"].str.count("\\.").max() >= 3
    # paths sort a conversation by turn numbers of any size and sign
    for _, part in got[got["conv_id"].notna() & got["turn"].notna()].groupby("conv_id"):
        top = part[part["reply_path"].str.count("\\.") == 0].drop_duplicates("turn").sort_values("reply_path")
        assert top["turn"].is_monotonic_increasing
