from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import splitting
from siltstone.llm.splitting import split_offsets

ALPHABET = st.sampled_from(list("ab ,.\n\n;。é😀"))


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text_within_limit_and_overlap(text, limit, overlap):
    spans = split_offsets(text, limit, overlap)
    assert "".join(text[max(a, (spans[i - 1][1] if i else 0)) : b] for i, (a, b) in enumerate(spans)) == text
    assert all(0 < b - a <= limit for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap


def test_cuts_stand_at_boundaries_and_not_after_abbreviations():
    text = ("The result is stated in Tab. 2 of the work. It holds for all of the maps. " * 60).strip()
    spans = split_offsets(text, 500, 100)
    assert all(text[b - 2 : b] == ". " and not text[:b].endswith("Tab. ") for _, b in spans[:-1])
    assert all(text[c - 2 : c] == ". " for c, _ in spans[1:])


def test_text_without_any_boundary_is_cut_hard():
    assert split_offsets("x" * 4500, 2000, 150) == [(0, 2000), (1850, 3850), (3700, 4500)]
    assert split_offsets("x" * 4500, 2000, 0) == [(0, 2000), (2000, 4000), (4000, 4500)]


def test_hard_cuts_part_no_letter_from_its_marks():
    text = "e\u0301\u0302" * 1500
    spans = split_offsets(text, 2000, 150)
    assert all(a % 3 == 0 and b % 3 == 0 and b - a <= 2000 for a, b in spans) and len(spans) == 3


def test_every_border_is_shared_and_token_limits_hold(spark, tiny):
    for r in splitting.p3_pieces(spark, tiny).orderBy("item_kind", "item_key", "item_no", "piece_no").collect():
        assert 0 < len(r.piece) <= 2000 and (r.piece_no == 0 or 1 <= last.stop - r.start <= 150)
        last = r
    from siltstone.llm.tokens import TOKENIZER, token_offsets

    offsets = token_offsets(TOKENIZER)
    text = ("Überlange Wörter und 漢字, dann noch ein Satz. " * 40) + "y" * 3000
    starts = offsets(text)
    spans = split_offsets(text, 100, 10, starts)
    for (a, b), (c, _) in zip(spans, spans[1:]):
        assert sum(a <= s < b for s in starts) <= 100 and a < c < b and sum(c <= s < b for s in starts) <= 10
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert splitting.p3_token_pieces(spark, tiny).where("n_pieces < 2 or length(piece) <> stop - start").count() == 0


def test_paragraphs_are_preferred():
    text = "word " * 300 + "\n\n" + "word " * 300
    assert text[: split_offsets(text, 2000, 150)[0][1]].endswith("\n\n")


def test_frame(spark):
    rows = [("a", "k", 1, "x" * 2000, "c"), ("a", "k", 2, "y" * 2001, "c"), ("a", None, None, "z " * 3000, "c"), ("a", "k", 3, None, "c"), ("a", "k", 4, "", "c"), ("a", "k", 2, "y" * 2001, "c")]
    df = spark.createDataFrame(rows, "item_kind string, item_key string, item_no int, text string, piece string")
    got = splitting.split_items(df).collect()
    assert {(r.item_key, r.item_no) for r in got} == {("k", 2), (None, None)}
    assert sum(r.item_no == 2 for r in got) == 4 and all(len(r.piece) == r.stop - r.start <= 2000 for r in got)
    assert splitting.split_items(df.limit(0)).count() == 0


def test_found_equals_lengths(spark, tiny):
    got = {tuple(r) for r in splitting.p3_found(spark, tiny).collect()}
    want = set()
    for r in spark.read.parquet(f"{tiny}/parsed_papers.parquet").collect():
        if r.sections:
            want |= {("section", r.id, i) for i, s in enumerate(r.sections) if s.text and len(s.text) > 2000}
        elif r.full_text and len(r.full_text) > 2000:
            want.add(("full_text", r.id, -1))
    for r in spark.read.parquet(f"{tiny}/chunk_lookup.parquet").collect():
        if r.text and len(r.text) > 2000:
            want.add(("chunk", r.chunk_key, r.chunk_id))
    assert got == want
