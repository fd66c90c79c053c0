import pytest

from foliospark.llm.html_extract import extract


@pytest.mark.parametrize(
    "page",
    [
        "<body class='has-sidebar'><p>text</body>",
        "<div id='content' class='no-sidebar'><p>text</div>",
        "<article class='post has-comments'><p>text</article>",
        "<main class='search-page'><p>text</main>",
        "<article class='sponsored'><p>text</article>",
        "<article><p class='byline'>text</article>",
        "<article><div class='related'>text</div></article>",
        "<article><math><mi>text</mi></math></article>",
    ],
)
def test_content_stays(page):
    assert extract(page) == "text"


@pytest.mark.parametrize("value", ["ad", "post ad", "cookie-notice", "site-header", "main-nav", "comments"])
def test_marked_parts_go(value):
    assert extract(f"<body><div class='{value}'>x</div><p>text</body>") == "text"
