"""Labelled pages from which the extraction weights are counted: ``[[`` and ``]]`` mark where the main text begins and ends."""

_WHOLE = [
    """<!DOCTYPE html><html><head><title>River levels rise</title><style>p{margin:0}</style></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav>
<div class="ad">Buy two get one free today</div>
[[<article><h1>River levels rise after a week of rain</h1><p>Water in the lower valley stood a metre above its usual mark
on Monday, and the <a href="/b">bridge</a> at the mill was closed to carts and cars.</p><p>Farmers moved their cattle to the higher
fields over the weekend.</p><p>More rain is expected.</p></article>]]
<footer>&copy; 2024 Valley Post &middot; <a href="/imprint">Imprint</a></footer></body></html>""",
    """<html><body><div id="header"><a href="/"><img src="logo.png"></a><form action="/search"><input name="q"><button>Search</button></form></div>
<div class="cookie-notice">We use cookies. <button>Accept</button></div><table><tr><td class="sidebar"><ul><li><a href="1">Recipes</a>
<li><a href="2">Garden</a><li><a href="3">Tools</a></ul></td><td>[[<h2>How to prune an apple tree</h2><p>Wait for a dry day in late winter.
Take out dead wood first, then branches that cross.<p>Cut just above a bud that points outward, and do not leave a stub.
<ul><li>Clean the blades with spirit.</li><li>Burn what is diseased.</li></ul><p>Step back often and look at the whole crown.]]</td></tr></table>
<div class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b> Thanks, this helped a lot!</div><div class="comment"><b>Jo</b> Mine died.</div></div>
<div id="footer"><a href="/about">About</a> <a href="/contact">Contact</a> <a href="/terms">Terms</a></div></body></html>""",
    """<html lang="en"><body class="has-sidebar"><header><h1><a href="/">The Daily Loom</a></h1><nav><a href="/a">Weaving</a> <a href="/b">Dyeing</a></nav></header>
<main>[[<h1>Madder root and its reds</h1><p>Madder was grown across the plain for two hundred years. The roots are dug in
the third autumn, dried, and ground between stones.</p><blockquote>No red lasts like it, the dyers said, and none smells worse.</blockquote>
<p>The cloth is first boiled with alum. A long, slow bath gives orange; chalk in the water turns it towards crimson.</p>
<pre>1 part root, 1 part cloth</pre><p>Rinse until the water runs clear.</p>]]</main><aside><h4>Related</h4><ul><li><a href="/w">Woad</a></li>
<li><a href="/i">Indigo</a></li></ul></aside><footer>All rights reserved. <a href="/p">Privacy</a></footer></body></html>""",
    """<html><body><div class="menu"><a href="/1">One</a> | <a href="/2">Two</a> | <a href="/3">Three</a></div><div class="breadcrumb"><a href="/">Home</a>
&gt; <a href="/x">Archive</a></div><div class="content">[[<h1>Minutes of the harbour board</h1><p>Present were the master, both wardens and the clerk.</p>
<p>The board agreed to dredge the north channel before the herring season, and to pay for it from the landing fees of the last two years.</p>
<p>The master reported three groundings since March. None did lasting harm.</p><p>The meeting closed at nine.</p>]]</div>
<div class="share"><a href="/s1">Share</a> <a href="/s2">Post</a></div><form><label>Newsletter</label><input><button>Sign up</button></form></body></html>""",
]

_PARAGRAPHS = [
    "The ferry left the north quay an hour late, with forty crates of apples and a piano on deck.",
    "Nobody had told the harbour master, who was at lunch, and the ropes were thrown to a boy selling papers.",
    "By the time the fog had lifted the tide was turning. The captain chose the long way round the island, past the two lighthouses and the wreck.",
    "It is the third delay this month. The company says that the engine is old, that parts come by train, and that the train is late as well.",
    "Passengers were given tea.", "A hearing is set for June, when the council will read the log and ask the crew what they saw.",
    "In the village the news was taken calmly: the bakery kept its ovens warm, and the school sent the older pupils to carry what had to be carried.",
]
_COMMENT = "Great piece, I was on that boat and can say that the tea was cold and the piano out of tune all the way home."
_NOTICE = "We and our partners store information on your device and need your consent for measurement and for adverts that suit you; you can change this at any time."
_MENU = '<div class="top-menu"><a href="/">Home</a> <a href="/a">Harbour</a> <a href="/b">Weather</a></div>'
#: Containers of whole articles, some with words that elsewhere mark what is not part of one.
_HOLDERS = [
    "", 'class="content"', 'class="post-content share-buttons-on"', 'class="story promo-story"', 'id="main-text" class="ad-free"', 'class="article social"', 'class="entry widget-entry"', 'class="news-banner-body"',
    'class="comment-article"', 'class="search-page"', 'class="alert-story"', 'id="login-page"', 'class="sponsored-news"', 'id="newsletter-archive"',
]
#: What stands around an article, by names that marks share with other words.
_AROUND = [
    "", '<div class="related-articles"><h3>More news</h3><p>Old engine fails again at sea.</p><p>Train late for the third time.</p></div>', '<div class="share-content"><p>Share this story with friends and family today</p></div>',
    '<div id="newsletter-body"><p>Get our best stories each morning in your post.</p></div>', '<div class="widget-text"><p>Opening hours are from nine to five on all days.</p></div>',
]


def _layouts() -> list[str]:
    """A page for each holder and kind of surroundings, with forms around all, long comments and long notices in turn."""
    out = []
    for i, holder in enumerate(_HOLDERS):
        for j, around in enumerate(_AROUND):
            n = i * len(_AROUND) + j
            text = "".join(f"<p>{p}</p>" for p in (_PARAGRAPHS * 2)[n % 7 : n % 7 + 4 + n % 4])
            comments = "".join(f'<div class="comment"><p>{_COMMENT}</p></div>' for _ in range(1 + 2 * (n % 3)))
            notice = f'<div class="cookie-notice"><p>{" ".join([_NOTICE] * (1 + 3 * (n % 5 == 0)))}</p></div>' if n % 2 else ""
            body = f'{notice}{_MENU}<div {holder}>[[<h1>Ferry late again</h1>{text}]]</div>{around}<div class="comments">{comments}</div><footer>Harbour Post</footer>'
            if n % 3 == 0:
                body = f"<form>{body}</form>"
            elif n % 3 == 1:
                body += '<form class="search-form"><p>Search the archive of the paper</p></form>'
            out.append(f"<html><body>{body}</body></html>")
    return out


PAGES = _WHOLE + _layouts()
