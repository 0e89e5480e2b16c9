import datetime as dt

from siltstone.llm import survivors

SCHEMA = "id string, title string, doi string, arxiv_id string, citation_count int, abstract string, created_at timestamp, component string, field_name string, core string"
DAY = dt.datetime(2025, 1, 1)


def frame(spark, rows):
    full = [(*r, DAY + dt.timedelta(days=i), "clash", "clash", "clash") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def best(spark, rows):
    return {(r.group_key, r.field_name): r.survivor for r in survivors.best_values(frame(spark, rows)).collect()}


def test_rows_are_tied_by_any_key_and_values_survive_field_by_field(spark):
    text = "We study ranking for maps. It works in all settings."
    found = best(
        spark,
        [
            ("b", "A <i>Study</i> of maps", "https://doi.example/10.99100/ABC.1.", None, 5, "We study ranking for maps. It…"),
            ("a", "A study of maps!", "10.98550/arXiv.2101.00001", "arXiv:2101.00001v2", None, "Abstract: " + text),
            ("c", "Another spelling", "doi:10.99100%2Fabc.1", "n/a", 7, text),
            ("d", "Yet another one", None, "https://arxiv.example/abs/2101.00001v4", -1, "n/a"),
            ("e", "A study of maps: a follow-up study", "10.99100/abc.2", None, 99, text + " More."),
        ],
    )
    assert found == {
        ("a", "doi"): "10.99100/abc.1",
        ("a", "arxiv_id"): "2101.00001",
        ("a", "citation_count"): "7",
        ("a", "abstract"): "c",
    }


def test_cut_titles_and_placeholders_tie_nothing(spark):
    rows = [("a", "A study of...", "10.", "0000.00000", 1, None), ("b", "A study of...", "unknown", "none", 2, None), ("c", None, "", "", None, ""), ("d", None, None, None, None, None)]
    assert best(spark, rows) == {}


def test_longest_piece_wins_where_no_row_is_whole_and_ties_go_to_the_smallest_id(spark):
    rows = [("c", "T one", None, None, None, "One two three [...]"), ("b", "T one", None, None, None, "One two three four..."), ("a", "t ONE", None, None, None, "One two three four…"), ("z", "T one", None, None, None, "T one")]
    assert best(spark, rows) == {("a", "abstract"): "a"}


def test_empty_null_ids_and_repeated_rows(spark):
    assert survivors.best_values(frame(spark, [])).count() == 0
    rows = [("a", "Same", None, None, 3, None), ("a", "Same", None, None, 3, None), (None, "Same", None, None, 9, None)]
    assert best(spark, rows) == {("a", "citation_count"): "3"}


def test_very_long_abstract_is_read_whole(spark):
    long = "word " * 40_000 + "end."
    rows = [("a", "Long", None, None, None, long + " © 2020 Some Press. All rights reserved."), ("b", "Long", None, None, None, long)]
    assert best(spark, rows) == {("a", "abstract"): "b"}


def test_hot_group(spark):
    rows = [(f"{i:05d}", "Hot title", f"10.99100/x.{i}", None, i, None) for i in range(3000)]
    found = best(spark, rows)
    assert found["00000", "citation_count"] == "2999" and len(found) == 2


def test_groups_equal_a_plain_union_find(spark, tiny):
    got = {r.id: r.group_key for r in survivors.p1_groups(spark, tiny).collect()}
    rows = survivors.publication_keys(spark.read.parquet(f"{tiny}/retrieved_papers.parquet").select("id", "title", "doi", "arxiv_id")).select("id", "keys").collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in rows:
        for k in r["keys"]:
            parent[find(k)] = find(r["keys"][0])
    first = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        first.setdefault(find(r["keys"][0]), r["id"])
    assert got == {r["id"]: first[find(r["keys"][0])] for r in rows}
