"""The block scanner against the patterns that define fences and tables, and its time on texts made of pipes."""

import re
import time

from hypothesis import example, given, settings, strategies as st

from tidepool.functions import blocks
from tidepool.operators.chunking import tree_rows

CODE = re.compile(r"```(?:(\w+)\n)?([\s\S]*?)```")
TABLE = re.compile(r"(\|.*\|[\s\S]*?\n)(?:\|.*\|.*\n)+")
PIECES = st.lists(st.sampled_from(["|", "||", "\n", "a", " ", "| b |", "|\n|", "\n| c | d |\n", "```", "`", "```py\n", "é", "\r", "\x85"]), max_size=40).map("".join)


@settings(max_examples=600, deadline=None)
@given(PIECES)
@example("| a |\nx\n| b |\n| c |\n")
@example("|a|\n|b|\n|c|")
def test_tables_equal_the_pattern(text):
    assert list(blocks.table_spans(text)) == [m.span() for m in TABLE.finditer(text)]
    assert blocks.table_texts(text) == [m[0].strip() for m in TABLE.finditer(text)]


@settings(max_examples=600, deadline=None)
@given(PIECES)
@example("````a```")
@example("```py\n``` ```py ```")
def test_code_equals_the_pattern(text):
    assert [(a, b, x or None, c) for a, b, x, c in blocks.code_spans(text)] == [(*m.span(), m[1], m[2]) for m in CODE.finditer(text)]
    assert blocks.plain_text(text) == TABLE.sub("", re.sub(r"```[\s\S]*?```", "", text)).strip()


def test_ten_megabytes_of_pipes_take_seconds():
    for text in ("|" * 10_000_000, "| a | b\n" * 1_200_000, "|x|\n\n" * 2_000_000, "```" * 3_000_000, "a|\n" * 3_000_000):
        start = time.process_time()
        blocks.plain_text(text)
        assert sum(1 for _ in blocks.table_spans(text)) >= 0
        assert time.process_time() - start < 15
    start = time.process_time()
    tree_rows(1, "pipes", "# head\n" + "| a | b | c\n" * 20_000)
    assert time.process_time() - start < 5


def test_columns(spark):
    df = spark.createDataFrame([(1, "x\n| a | b |\n| 1 | 2 |\nend ```sql\nselect 1\n``` done"), (2, None), (3, ""), (4, "a | b")], "doc_id long, t string")
    rows = {r.doc_id: r for r in df.select("doc_id", blocks.tables(df.t).alias("tables"), blocks.code(df.t).alias("code"), blocks.without_blocks(df.t).alias("rest")).collect()}
    assert rows[1].tables == ["| a | b |\n| 1 | 2 |"] and [tuple(c) for c in rows[1].code] == [("sql", "select 1")] and rows[1].rest == "x\nend  done"
    assert rows[2].tables is None and rows[2].code is None and rows[2].rest is None
    assert (rows[3].tables, rows[3].code, rows[3].rest) == ([], [], "") and rows[4].rest == "a | b"
