from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.functions.text import locate, question_terms, segments


@given(st.text(alphabet="ab .!?\né漢\U0001f600", max_size=400), st.integers(4, 60))
@settings(deadline=None)
def test_segments_join_to_the_text_and_keep_the_ceiling(text, ceiling):
    pieces = segments(text, ceiling)
    assert "".join(pieces) == text
    assert all(len(p.encode()) <= ceiling and p for p in pieces)


def test_segments_prefer_paragraphs_then_sentences_then_spaces():
    assert segments("aa. bb\n\ncc. dd", 12)[0] == "aa. bb\n\n"
    assert segments("aa. bb cc dd ee", 10)[0] == "aa. "
    assert segments("aaaa bbbb cccc", 10)[0] == "aaaa bbbb "


def test_terms_have_windows_and_possessives_once():
    terms = question_terms("Where does Ann-Marie's brother, Bob live?")
    assert "ann-marie's brother" in terms and "ann-marie" in terms and "bob" in terms and "brother bob live" in terms
    assert len(terms) == len(set(terms)) and max(len(t.split()) for t in terms) == 4


def test_quotes_are_found_exactly_or_with_other_white_space():
    content = "Ünï said:  we  met\nin Köln."
    assert locate(content, "said:") == (len("Ünï ".encode()), len("Ünï said:".encode()))
    a, b = locate(content, "we met in Köln")
    assert content.encode()[a:b].decode() == "we  met\nin Köln"
    assert locate(content, "We met") is None and locate(content, "  ") is None and locate("", "x") is None
