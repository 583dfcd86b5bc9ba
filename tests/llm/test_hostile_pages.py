import time

import pytest

from boxmill.llm import language_id


@pytest.mark.parametrize("mark", ["<html ", "<!--", "<script>", "<", "<script></script ", "lang ", "<!-- -"])
def test_unclosed_marks_take_one_pass(mark):
    """A page of five million characters, which took hours when every mark was looked for an end of its own."""
    page = mark * (5_000_000 // len(mark))
    begun = time.time()
    language_id.visible_text(page)
    language_id.declared_language(page)
    assert time.time() - begun < 15


def test_marks_in_each_other():
    assert language_id.visible_text("a<script>b</SCRIPT >c<!--d-->e<p>f&amp;g") == "a c e f&g"
    assert language_id.visible_text("a<!--b<script>c</script>d").split() == ["a<!--b", "d"]
    assert language_id.visible_text("x < y <b>z") == "x  z"
    assert language_id.declared_language("<html><html class=x lang='de-AT'>") == "de"
    assert language_id.declared_language("<html class=x <html lang=fr") == "fr"
    assert language_id.declared_language("<html> lang=fr") is None


def test_domains_below_registered_names():
    assert language_id.host_parts("https://news.shop.co.uk/a") == ("news.shop.co.uk", "shop.co.uk", "uk")
    assert language_id.host_parts("https://co.uk/a") == ("co.uk", "co.uk", "uk")
    assert language_id.host_parts("https://a.b.com/") == ("a.b.com", "b.com", "com")
    assert language_id.host_parts(None) == ("", "", "")
