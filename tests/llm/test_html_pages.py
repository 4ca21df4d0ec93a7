"""Hand-labelled pages: what the article holds stays, what stands around it goes; deep pages take linear time."""

import time

import pytest

from quillspark.llm.htmltext import main_text

LONG = "nice, very nice. " * 40
PAGES = {
    "heading_beside_text": ("<body><div class=post><h1>Title</h1><div class=text><p>One, two, three, four five six.</p><p>Seven, eight, nine, ten.</p></div></div><div class=footer>foot</div>", "Title\nOne, two, three, four five six.\nSeven, eight, nine, ten."),
    "linked_items": ("<article><h1>T</h1><p>Some text, with commas, and more.</p><ul><li><a href=x>Source one</a></li><li>plain</li></ul></article>", "T\nSome text, with commas, and more.\nSource one\nplain"),
    "words_in_ids": ("<article><h1>T</h1><p>Some text, with commas.</p><section id='related-work'><h2>Related work</h2><p>Prose, prose.</p></section><div class='related-posts'><a href=a>One</a> <a href=b>Two</a></div></article>", "T\nSome text, with commas.\nRelated work\nProse, prose."),
    "comments": (f"<main><h2>T</h2><p>Body text, body text.</p><div id='comments'><article class='comment'><p>{LONG}</p></article></div></main>", "T\nBody text, body text."),
    "notices": (f"<body><div class='cookie-notice'>We use cookies. {LONG}</div><div id=content><p>Para one, text, text.</p><p>Para two.</p></div><div class='sidebar'><p>{LONG}</p></div><form><label>x</label><input></form>", "Para one, text, text.\nPara two."),
    "weak_words": (f"<article><p>First, first.</p><div class='related'><a href=x>Other page</a></div><div class='share'>Tell others</div><div class='notice'><p>{LONG}</p></div></article>", f"First, first.\n{LONG.strip()}"),
    "hidden_and_raw": ("<article><p>a &lt;b&gt; &#233;<script>x</script><style>y</style><p hidden>no<p style='display:none'>no<pre>x\n  y</pre><template>t</template></article>", "a <b> é\nx y"),
    "layout_names": ("<body class='no-sidebar'><div id='wrapper' class='with-sidebar'><div class='header-image'><p>One, two, three, four.</p></div><nav>m</nav><p>Five, six, seven.</p></div>", "One, two, three, four.\nFive, six, seven."),
    "two_sections": ("<div class=content><section><p>Long, long, long, long, long text here.</p><p>More, more, more.</p></section><section><p>Short end.</p></section></div>", "Long, long, long, long, long text here.\nMore, more, more.\nShort end."),
    "stray_tags": ("</p></div><p>x, y</i></article><td>z</td></p>", "x, y\nz"),
    "page_in_a_form": ("<body><form id='aspnetForm'><div class=nav><a href=x>m</a></div><div id=content><h1>T</h1><p>One, two, three.</p><p>Four, five.</p></div></form>", "T\nOne, two, three.\nFour, five."),
    "form_in_a_page": ("<article><p>Text, text.</p><form action=x><p><label>Mail</label><input><button>Go</button></p></form></article>", "Text, text."),
    "marked_heading_and_warning": ("<article><h1 class='page-header'>Head</h1><p>One, two, three.</p><p class='alert'>Do not mix bleach and acid.</p></article>", "Head\nOne, two, three.\nDo not mix bleach and acid."),
    "controls_in_sentences": ("<article><p>Press <button>OK</button> to go on, please.</p><p>Pick <label>this one</label>, then that.</p><div><button>Menu</button></div></article>", "Press OK to go on, please.\nPick this one, then that."),
    "replies_beside": ("<body><div class=story><p>One, two, three.</p><p>Four, five, six, seven.</p></div><div class=replies><p>Great, great, great post, wow, yes.</p></div>", "One, two, three.\nFour, five, six, seven."),
    "discussions": ("<article><p>One, two, three.</p><section class=discussion><p>I think, I think, so.</p></section><section id=discussion><h2>Discussion</h2><p>We discuss.</p></section></article>", "One, two, three.\nDiscussion\nWe discuss."),
    "notice_beside": ("<body><div class=notice><p>We have moved.</p></div><div id=content><p>One, two, three, four, five.</p><p>Six, seven, eight.</p></div>", "One, two, three, four, five.\nSix, seven, eight."),
    "no_text": ("<nav>menu</nav><img src=x>", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page(name):
    page, want = PAGES[name]
    assert main_text(page) == want


def test_deep_pages():
    for page in ("<div><p>text, with words" * 8000, "<b><div>" * 8000 + "t, t</span></i></b>" * 8000, "<ul><li>" * 8000 + "x"):
        start = time.process_time()
        assert main_text(page)
        assert time.process_time() - start < 3
