from demandloom.llm.lines import dedup_lines


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_recurring_lines_go_and_the_first_stays(rows):
    common = "all of these words stand here in every single document today"
    varied = "user {} logged in from the office at some hour of day"
    docs = rows((1, f"{common}\nown line one"), (2, f"before\n{common}\nafter\n"), (3, varied.format(17)), (4, varied.format(99815)), (5, None), (6, ""),
                (7, f"Start of it. {common.capitalize()}. End here."), (8, f"Other start. {common.capitalize()}. Other end."), (9, "same here\n" * 3), (2, "unlike"), more=True)
    got = dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == 10
    t = texts(got.where("text <> 'unlike' or text is null"))
    assert t[1] == f"{common}\nown line one" and t[2] == "before\nafter\n"
    assert t[3] == varied.format(17) and t[4] == "" and t[5] is None and t[6] == ""
    assert t[7].endswith("End here.") and t[8] == "Other start. Other end." and t[9] == "same here\n" * 3


def test_one_open_field_and_clean_lines(rows):
    line = "the server at rack {} answered with an error after ten long seconds of waiting"
    docs = rows((1, line.format("north")), (2, line.format("south")), (3, "the server at rack north was moved to another place by the night team"), (4, "the end"), (5, "the end"))
    assert texts(dedup_lines(docs))[2] == "" and texts(dedup_lines(docs))[3].startswith("the server") and texts(dedup_lines(docs))[5] == "the end"


def test_a_passage_inside_a_line_goes(rows):
    passage = " ".join(f"{a} sentence number of this passage has quite many words in it." for a in ("First", "Second", "Third", "Fourth", "Fifth", "Sixth"))
    got = texts(dedup_lines(rows((1, f"own words and {passage} mine alone"), (2, f"other start {passage} something else"))))
    assert "Third sentence" in got[1] and "Third sentence" not in got[2] and "something else" in got[2]


def test_empty_and_very_long(rows):
    assert dedup_lines(rows().limit(0)).count() == 0
    long = "word " * 20000
    assert texts(dedup_lines(rows((1, long), (2, long)))) == {1: long, 2: ""}
