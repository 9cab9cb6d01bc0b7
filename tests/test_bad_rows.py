import random

from hypothesis import given, settings
from hypothesis import strategies as st

from meshquarry.operators import bad_rows as B

CASES = {
    "v 1 2 3": None, "v +.5 1e3 -2.": None, 'v "0.5" 1 2': None, 'v ""0.5" 1 2': "quote", "v 1 2": "columns", "v 1 2 3 4 5": "columns",
    "v 1 2 3 4 5 6": None, "v 1 nan 2": "value", "v 1e999 1 2": "value", "v 0x1A 1 1": "value", "v +-1 2 3": "value", "v 1_0 2 3": "value",
    "V 1 2 3": "tag", "f 1 2": "columns", "f 1 2 3": None, "f 1/2 2/3 3/1": None, "f 1//2 2//3 3//1": None, "f 1/ 2 3": "value", "f 1 2 x": "value",
    "f 1 2 1.0": "value", "": None, "  \t": None, "# \"": None, 'o "a b"': None, 'o "a b': "quote", "w 1": "tag", "\r": None, "v 1 2 3\r": None, "f\r": "columns",
    "f 1 2 9": "range", "f 1 2 0": "range", "f -1 -2 -3": None, "f -1 -2 -99": "range", None: None, "f 1/1/1/1 2 3": "value", "s off": None, "v 1 2 3 1_0": "value",
}


def test_cases_against_strict_rules(spark):
    rows = [(i, "a.obj", i, k) for i, k in enumerate(CASES)]
    got = {r.line_id: r.reason for r in B.parse_obj_lines(spark.createDataFrame(rows, "line_id long, obj_file string, line_no int, raw_line string")).collect()}
    n_v = sum((k or "").strip(" \t\r").split(" ")[0] == "v" for k in CASES)
    assert n_v > 9
    want = {i: v for i, v in enumerate(CASES.values())}
    want[list(CASES).index("f 1 2 9")] = None  # 9 is within the vertex lines of this file
    assert got == want


def test_range_counts_faulty_vertices_and_files_apart(spark):
    rows = [(1, "a", 1, "v 1 2"), (2, "a", 2, "v x 1 1"), (3, "a", 3, "f 1 2 3"), (4, "b", 1, "f 1 1 1"), (5, None, 1, "f 1 1 1"), (6, "a", 4, "f 1 2 2"), (6, "a", 4, "f 1 2 2")]
    got = sorted((r.line_id, r.reason) for r in B.faulty_lines(spark.createDataFrame(rows, "line_id long, obj_file string, line_no int, raw_line string")).collect())
    assert got == [(1, "columns"), (2, "value"), (3, "range"), (4, "range"), (5, "range")]


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "line_id long, obj_file string, line_no int, raw_line string, reason string, worst int")
    assert B.faulty_lines(df).count() == 0


PIECES = st.sampled_from(["v", "f", "g", "#", "1", "-2", "0.5", "+.5", "1/2", "1//2", "1/2/3", '"', '"1"', "nan", "1e5", "\t", " ", "x", "1e", "--1", "+-1", "1.", "\r", "inf", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=8), min_size=1, max_size=9))
def test_bulk_equals_strict(lines):
    text = [random.choice([" ", "  "]).join(x) for x in lines]
    assert B.parse_block(text) == [B.diagnose(t) for t in text]
