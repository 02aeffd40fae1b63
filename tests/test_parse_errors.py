import csv
import itertools
import json
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gazeloom.operators import parse_errors as P

LINE = r'("(?:[^"]|"")*"|[^",]*)(,("(?:[^"]|"")*"|[^",]*))*'


@given(st.text(alphabet='a1.,"" ', max_size=30))
@settings(max_examples=300, deadline=None)
def test_zero_cost_means_well_quoted_and_six_fields(line):
    cost, edits = P.csv_parse(P.csv_structure(line), 6)
    if re.fullmatch(LINE, line, re.DOTALL):
        fields = next(csv.reader([line], strict=True)) if line else [""]
        assert cost == (0, 0, abs(len(fields) - 6)) and "quote" not in edits and len(edits.split()) == sum(cost)
        if not any(cost):
            assert P.csv_fields(line) == fields
    else:
        assert cost.quotes and "quote" in edits and len(edits.split()) == sum(cost)


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=8))
@settings(max_examples=200, deadline=None)
def test_json_costs_nothing_only_for_one_object(value):
    for text in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=1)):
        assert (not any(P.json_parse(P.json_structure(text)[0])[0])) == isinstance(value, dict)


@given(st.text(alphabet='{}[]:,"\\1a tN', max_size=16))
@settings(max_examples=400, deadline=None)
def test_json_agrees_with_a_strict_parser(text):
    try:
        sound = isinstance(json.loads(text, parse_constant=lambda c: 1 / 0), dict)
    except (ValueError, ZeroDivisionError):
        sound = False
    assert (not any(P.json_parse(P.json_structure(text)[0])[0])) == sound


def test_least_edits():
    assert P.csv_parse(P.csv_structure('1,2,3,4,5,"open'), 6)[1] == "-quote@10"
    assert P.csv_parse(P.csv_structure("1,2,3"), 6)[0] == (0, 0, 3)
    assert P.csv_parse(P.csv_structure("1,2,3,4,5,6,7"), 6)[1].count("-delimiter") == 1
    assert P.json_parse(P.json_structure('{"a":1 "b":2}')[0])[0] == P.DELIMITER
    assert P.json_parse(P.json_structure('"a":1}')[0])[1] == "+delimiter@0"


def test_quote_edits_are_least():
    """Against all ways of inserting and deleting quotes, on every short line."""
    for n in range(7):
        for line in map("".join, itertools.product('",x', repeat=n)):
            if "xx" not in line:
                assert P.csv_parse(line, 2)[0].quotes == fewest_quotes(line), line


def fewest_quotes(line):
    edits, lines = 0, {line}
    while not any(re.fullmatch(LINE, t) for t in lines):
        edits += 1
        longer = {t[:i] + '"' + t[i:] for t in lines for i in range(len(t) + 1)}
        lines = longer | {t[:i] + t[i + 1 :] for t in lines for i in range(len(t)) if t[i] == '"'}
    return edits


def test_long_records():
    cost, edits = P.csv_parse(P.csv_structure("a," * 20_000), 6)
    assert cost == (0, 0, 19_995) and len(edits.split()) == 19_995  # one by one at any length
    assert P.csv_parse(P.csv_structure('"' + "x" * 1_000_000 + '",1,2,3,4,5'), 6)[0] == (0, 0, 0)
    assert P.csv_parse(P.csv_structure('"' * 5_001), 6)[0] == (1, 0, 5)
    cost, edits = P.csv_parse('x"' * 1_000_000, 6)
    assert cost == (1_000_000, 0, 5) and edits.count("quote") == 1_000_000
    assert P.csv_parse("," * (1 << 20) + ",,,,,", 6)[0] == (0, 0, 1 << 20)  # surplus delimiters stay delimiters


def test_gaze_lines(spark):
    lines = {
        "1,2,3,1,,": None, '"1",2,3e2,True,6,"say ""a"", b"': None, " 1 ,2,0, false ,.5,x": None, "1,2,3,1,": "column_count", "": "column_count",
        '1,2,3,1,5,a"b': "malformed", '1,2,3,1,5,"a"b"': "malformed", "nan,2,3,1,5,": "invalid_value", "1,2,,1,5,": "invalid_value",
        "1,2,-1,1,5,": "invalid_value", "1,2,3,yes,5,": "invalid_value", "1e999,2,3,1,5,": "invalid_value", "1,2,3,,5,": "invalid_value",
    }
    rows = [(i, t, "here", "x") for i, t in enumerate(lines)] + [(99, None, "here", "x"), (0, "1,2,3,1,,", "here", "x"), (100, "1" * 100_000 + ",2,3,1,5,", None, "x")]
    df = spark.createDataFrame(rows, "record_id bigint, raw string, reason string, _parsed string")
    got = P.parse_gaze_lines(df).select("record_id", "reason", "typed").collect()
    reasons = {r.record_id: r.reason for r in got}
    assert len(got) == len(rows) and reasons[99] == "malformed" and reasons[100] == "invalid_value"
    assert [reasons[i] for i in range(len(lines))] == list(lines.values())
    typed = {r.record_id: r.typed for r in got}
    assert typed[1].timestamp == 300.0 and typed[1].gaze_point_validity and typed[1].remark == 'say "a", b' and typed[0].left_z is None
    assert typed[99] is None and math.isclose(typed[2].left_z, 0.5) and typed[2].gaze_point_validity is False


def test_meta_objects(spark):
    sound = {"radiologist": " A0012 ", "fname": "x.PNG", "global_ind": 1, "num_part": 2, "num_img": 3, "x0": 1.5, "y0": 0, "win_width": 3e2, "win_height": 4}
    change = lambda **kw: json.dumps(sound | kw)
    texts = {
        json.dumps(sound): None, change(extra=1): "column_count", json.dumps({k: v for k, v in sound.items() if k != "x0"}): "column_count",
        change(radiologist="e0012"): "invalid_value", change(radiologist=12): "invalid_value", change(x0="1"): "invalid_value", change(x0=True): "invalid_value",
        change(x0=None): "invalid_value", change(y0=[]): "invalid_value", change(fname="x.jpg"): "invalid_value", change(radiologist=["a0012"]): "invalid_value",
        json.dumps(sound)[:-1]: "malformed", json.dumps(sound) * 2: "malformed", "[1]": "malformed", "": "malformed", json.dumps(sound).replace("1.5", "NaN"): "malformed",
        json.dumps(sound).replace('"x0"', "'x0'"): "malformed", json.dumps(sound).replace("{", '{"x0": 1, ', 1): "column_count", "{}": "column_count",
        change(extra={"a": {"b": [1]}}): "column_count",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "record_id bigint, raw string")
    got = {r.record_id: r for r in P.parse_meta_objects(df).collect()}
    assert [got[i].reason for i in range(len(texts))] == list(texts.values()) and got[99].reason == "malformed"
    assert got[0].typed.radiologist == "a0012" and got[0].typed.win_width == 300.0 and got[0].typed.num_img == 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], "record_id bigint, raw string")
    assert P.parse_gaze_lines(empty).count() == 0 and P.parse_meta_objects(empty).count() == 0
