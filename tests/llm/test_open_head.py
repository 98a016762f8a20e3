"""Pages that leave out the closing tag of the head."""

from tarnql.llm.html_blocks import blocks


def test_an_open_head_ends_where_the_body_begins():
    def seen(page):
        return [b.text for b in blocks(page)]

    head = "<html><head><meta charset=utf-8><title>t</title><style>p{}</style><script>var x</script><link rel=x>"
    assert seen(head + "<body><article><p>one<p>two</article></body></html>") == ["one", "two"]
    assert seen(head + "<article><p>one</p></article>") == ["one"]
    assert seen(head + "<span>one</span> two<p>three") == ["one two", "three"]
    assert seen(head + " one <p>two") == ["one", "two"] and seen(head + "one") == ["one"]
    assert seen(head + "<img src=x>one<select><option>no</select>") == ["one"]
    assert seen(head + "<noscript><p>no</p></noscript><template><div>no</div></template></head><body>one") == ["one"]
    assert "head" not in blocks(head + "<body><p>one")[0].path.tokens()
