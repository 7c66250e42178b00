"""Duplicates hidden by formatting, on small fixtures with nulls, odd characters and a hot group."""

from weftmark.llm import format_duplicates


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_format_duplicates(spark):
    data = [
        ("r", "a", "Read Cursor()", "code", '{"x": 1, "y": "B c"}', "c_label"), ("r", "b", "read_cursor", "CODE", '{"y":"b  C","x":1}', None), ("r", "c", "«READ\u3000CURSOR»", "co-de", '{"x": 1, "y": "bc", "z": 2}', None),
        ("r", "d", "...", None, None, None), ("r", "e", "  ", "", None, None), ("r", "f", "Maße", None, "", None), ("r", "g", "MASSE", "", None, None), ("s", "h", "read cursor", "code", '{"x": 1, "y": "bc"}', None),
        ("r", None, "read cursor", "code", '{"x": 1, "y": "bc"}', None), ("r", "i", None, None, None, None), ("r", "j", "masse", None, "not json", None), ("r", "B", "readcursor", "code", '{"y": "b.c", "x": "1"}', None),
    ]
    df = spark.createDataFrame(data, "repo string, id string, label string, file_type string, attrs string, c_label string")
    fields = ["label", "file_type", "attrs"]
    assert rows(format_duplicates.copies(df, fields, ("attrs",))) == [("r", "B", "a"), ("r", "B", "b"), ("r", "f", "g")]
    counts = {tuple(r) for r in format_duplicates.collapsed(df, fields, ("attrs",)).collect()}
    assert ("r", "B", 3) in counts and ("r", "c", 1) in counts and ("s", "h", 1) in counts and len(counts) == 5
    assert format_duplicates.copies(df.limit(0), fields, ("attrs",)).count() == 0


def test_hot_group_of_copies(spark):
    data = [("r", f"n{i:04}", "One  Label" if i % 2 else "one label!") for i in range(900)] + [("r", f"x{i}", f"label {i % 300}") for i in range(600)]
    got = format_duplicates.copies(spark.createDataFrame(data, "repo string, id string, label string"), ["label"])
    assert got.where("first_id = 'n0000'").count() == 899 and got.count() == 899 + 300
