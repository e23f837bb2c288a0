import random

import duckdb
import pytest

from dotspark.llm import chat_format
from dotspark.llm.queries import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string, depth string, reply_to string"
CASES = {
    "branches": [
        (1, 0, "user", "First line.\nSecond  LINE here.", "x", "y"),
        (1, 1, "assistant", "An answer\nwith two lines.", "x", "y"),
        (1, 2, "user", "> First line.\nBack to the start.", "x", "y"),
        (1, 3, "assistant", "On it.", "x", "y"),
        (1, 4, "user", "> > first   line.\n> Back to the start.\nNested.", "x", "y"),
        (1, 5, "user", ">> First line.\nDeep only.", "x", "y"),
        (1, 6, "user", "> with two lines.\n> second line here.\n> an answer\nTies and votes.", "x", "y"),
        (1, 7, "user", "> never said\nUnfound.", "x", "y"),
    ],
    "nulls": [(1, 0, None, None, None, None), (1, 1, "user", "", None, None), (2, None, "user", "a", None, None), (None, 3, "user", "b", None, None), (1, 2, "user", "> \n>\n", None, None)],
    "repeats": [(1, 0, "user", "same", "", ""), (1, 0, "user", "same", "", ""), (1, 3, "user", "> same\nagain", "", ""), (1, 5, "user", "same", "", ""), (1, 2500, "user", "> same\nlate", "", ""), (1, 2501, "user", "x", "", ""), (1, 2600, "user", "> again\nfar", "", "")],
    "long": [(7, t, "user", "word " * 20000 + f"\nline {t}" + (f"\n> line {t - 3}" if t % 3 == 0 else ""), "", "") for t in range(12)],
    "empty": [],
}


def thread(conversations=40, turns=60, seed=8):
    """Nested replies: a message quotes an earlier one's lines, quotes and all, and lines that many others have too."""
    r, out = random.Random(seed), []
    for c in range(conversations):
        said = []
        for t in range(turns):
            own = [f"Line {c} {t} {i}" for i in range(r.randrange(1, 4))] + (["I agree."] if r.random() < 0.5 else [])
            quoted = ["> " + line for line in said[r.randrange(len(said))].split("\n")] if said and r.random() < 0.6 else []
            said.append("\n".join(quoted[: r.randrange(1, 8)] + own))
        out += [(c, 3 * t, r.choice(["user", "assistant"]), text, "", "") for t, text in enumerate(said)]
    return out


CASES["thread"] = thread()


@pytest.mark.parametrize("case", CASES)
def test_against_sql(spark, case):
    rows = spark.createDataFrame(CASES[case], SCHEMA)
    got = chat_format.conversations(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if CASES[case]:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in CASES[case]])
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op9_chat_format']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_order_and_links(spark):
    out = {r.turn: r for r in chat_format.conversations(spark.createDataFrame(CASES["branches"], SCHEMA)).collect()}
    assert [out[t].reply_to for t in range(8)] == [None, 0, 0, 2, 2, 2, 1, 6]
    assert [t for t in sorted(out, key=lambda t: out[t].reply_path)][:3] == [0, 2, 4]
    assert out[4].text == "Nested."


def test_turns_of_any_size_keep_their_order(spark):
    """Paths sort like the turns, from the smallest to the greatest whole number."""
    turns = [-(2**63), -(2**63) + 1, -(10**12), -11, -5, -1, 0, 1, 9, 10, 1700000000001, 1700000000999, 2**63 - 1]
    rows = spark.createDataFrame([("c", t, "user", f"line {t}") for t in turns], "conv_id string, turn long, role string, text string")
    out = chat_format.conversations(rows).collect()
    assert [r.turn for r in sorted(out, key=lambda r: r.reply_path)] == turns and len({r.reply_path for r in out}) == len(turns)
