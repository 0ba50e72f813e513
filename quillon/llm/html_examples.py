"""The small labelled table of the HTML extractor: pages, each with the texts of the blocks that are its article."""

_LONG = "The river had risen for three days before anyone in the lower town began to move their things upstairs, and by then the road was gone."
_MORE = "Nobody could say later who rang the bell first, though many people remember the sound, and the dogs that would not be quiet all night."
_MID = "It was the wettest spring in a century."
_SHORT = "Then it stopped."
_THIRD = "In the morning the square lay under a hand of brown water, and boats that belonged to nobody were tied to the lamp posts as if they had always been there."
_FOURTH = "We ask all who come here to read these lines with care before they go on, because there are rules in this house that hold for every guest and for every day."
_LINKED = "The mill, the old bridge and the school were closed for a week while the council looked for another way to bring bread and milk into the lower streets."

#: (page, article blocks). Blocks are told apart by their text, so what is kept is worded unlike what is dropped.
PAGES = [
    (
        f"<html><head><title>Flood</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/x'>Sport</a></li></ul></nav><div class='ad'>And here is a bright new car.</div>"
        f"<article><h1>The flood</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MORE} <a href='/d'>Dogs</a></p></article><footer>&copy; Town Paper &middot; {_MID}</footer></body></html>",
        ["The flood", _LONG, _SHORT, f"{_MORE} Dogs"],
    ),
    (
        f"<body><header><h1>Town Paper</h1><p>{_MID}</p></header><main><h2>After the water</h2><p>{_LONG}</p><ul><li>Bring boots.</li><li>Bring bread.</li></ul><p>Go.</p>"
        f"<div class='share'><a href='#'>Share</a></div><div class='comments'><p>{_MORE}</p><p>So true.</p></div></main><aside><p>Also read this. {_LONG}</p></aside><footer><p>{_MORE}</p></footer></body>",
        ["After the water", _LONG, "Bring boots.", "Bring bread.", "Go."],
    ),
    (
        f"<body><div id='cookie-notice'>We use cookies. {_MID}</div><div id='menu'><a href='/'>Start</a> <a href='/a'>About us</a></div><div id='content'><h1>A quiet night</h1><p>{_LONG}</p>"
        f"<p>{_MORE}</p><p>{_MID}</p></div><div class='sidebar'><p>Seen today. {_LONG}</p></div><form><p>Your address here</p></form><div id='footer'>Imprint. {_MID}</div></body>",
        ["A quiet night", _LONG, _MORE, _MID],
    ),
    (
        f"<body><p><a href='/'>Home</a></p><p><a href='/1'>One thing and another</a> <a href='/2'>Two</a></p><h1>Plain page</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MORE}</p><p>{_LONG} <a href='/l'>link</a></p>"
        f"<p><a href='/3'>Next page of this long story</a></p><p><a href='/4'>Contact</a> <a href='/5'>Imprint</a></p></body>",
        ["Plain page", _LONG, _SHORT, _MORE, f"{_LONG} link"],
    ),
    (
        f"<body><div role='banner'>{_MID}</div><article class='post'><header><h1>Letter</h1></header><p>{_SHORT}</p><blockquote>{_LONG}</blockquote><p><a href='/a'>A linked line</a></p>"
        f"<div class='advertisement'>Buy now. {_LONG}</div><p>{_MORE}</p><aside>{_MID}</aside></article><section id='comments'><article class='comment'><p>I agree. {_LONG}</p></article></section></body>",
        ["Letter", _SHORT, _LONG, "A linked line", _MORE],
    ),
    ("<body><ul><li><a href='/a'>Apples</a></li><li><a href='/b'>Bread and butter</a></li></ul><p><a href='/c'>All goods of this shop in one list</a></p></body>", []),
    (f"<body><div class='top-nav'><p>{_THIRD}</p></div><p>{_MORE}</p><p>{_LONG} {_MID}</p><div id='reader-comments'><p>{_FOURTH}</p></div></body>", [_THIRD, _MORE, f"{_LONG} {_MID}"]),
    (f"<body><p>{_LINKED}</p><p>{_MORE}</p><div id='comments'><p>{_FOURTH}</p></div></body>", [_LINKED, _MORE]),
    (f"<article><div class='social-history'><p>{_LONG}</p></div><div class='comments'><p>{_MORE}</p></div></article>", [_LONG]),
    (f"<body><article><h1>Mills</h1><p>{_THIRD}</p><p>{_LINKED}</p><div class='comments'><p>{_FOURTH}</p></div></article></body>", ["Mills", _THIRD, _LINKED]),
    ("<body><p>Yes</p></body>", ["Yes"]),
    ("<body><p>Yes</p><p>No, not at all</p></body>", ["Yes", "No, not at all"]),
    ("<body><nav>Menu</nav><article>Yes<div class='comments'>No</div><aside>Left</aside>Well</article><footer>End</footer></body>", ["Yes", "Well"]),
    (f"<body><h1>Short note</h1><p>{_MID}</p><p>{_SHORT}</p></body>", ["Short note", _MID, _SHORT]),
    (f"<body><article><ul><li><a href='/s1'>Part one of the story</a></li><li><a href='/s2'>Part two</a></li></ul><p>{_LONG}</p></article></body>", [_LONG]),
    (f"<body><article><h1>Bread</h1><p>{_LONG}</p><ul><li><a href='/s1'>Mills</a></li><li><a href='/s2'>Bread and butter</a></li><li><a href='/s3'>Weather</a></li></ul><p>{_THIRD}</p></article></body>", ["Bread", _LONG, _THIRD]),
    (
        f"<body><p><a href='/'>Home</a> <a href='/n'>News</a> <a href='/s'>Sport</a></p><p>{_MID}</p><p><a href='/w'>All the news of the week</a></p><h2>The mill</h2><p>{_LONG}</p><p>{_SHORT}</p><p>{_MORE}</p>"
        f"<p><a href='/m'>More of this kind</a></p><p>Printed daily.</p><p><a href='/i'>Imprint</a></p></body>",
        ["The mill", _LONG, _SHORT, _MORE],
    ),
    (
        f"<body><div class='top-menu'><a href='/'>Start</a> <a href='/a'>About</a></div><div class='social-history'><h1>A social history</h1><p>{_LONG}</p><p>{_MORE}</p><p>{_SHORT}</p></div>"
        f"<div class='social'><a href='/s'>Tell others</a></div><div class='cookie-notice'><p>{_FOURTH}</p></div></body>",
        ["A social history", _LONG, _MORE, _SHORT],
    ),
    (
        f"<body><div id='share-prices'><h2>Prices</h2><p>{_THIRD}</p><p>{_MID}</p><p>{_LONG}</p></div><div class='comments-section'><p>{_MORE}</p><p>Well said.</p></div><div class='ad-box'><p>{_FOURTH}</p></div></body>",
        ["Prices", _THIRD, _MID, _LONG],
    ),
    (
        f"<body><table><tr><td><a href='/1'>One</a></td><td><a href='/2'>Two</a></td></tr><tr><td>Weather</td><td><a href='/3'>Three and more</a></td></tr></table><table><tr><td><h1>Bread</h1><p>{_LINKED}</p><p>{_THIRD}</p></td></tr></table>"
        f"<p><a href='/4'>Back to the list of stories</a></p><p>All rights reserved.</p></body>",
        ["Bread", _LINKED, _THIRD],
    ),
    (
        f"<body><div><a href='/a'>First page</a></div><div>Edition of today</div><div><a href='/b'>Second page</a></div><div><p>{_LINKED} <a href='/c'>The council</a> <a href='/d'>The mill</a> said so.</p><p>{_SHORT}</p><p>{_LONG}</p></div>"
        f"<div><a href='/e'>Read also: another long story about bread</a></div><div>Write to us</div><div><a href='/f'>Contact</a></div></body>",
        [f"{_LINKED} The council The mill said so.", _SHORT, _LONG],
    ),
    (f"<body><div class='notice'><p>{_FOURTH}</p></div><div class='sidebar-left'><p>{_THIRD}</p></div><div class='story'><p>{_LONG}</p><p>{_SHORT}</p></div><div class='related-box'><p>{_LINKED}</p></div></body>", [_LONG, _SHORT]),
]

_TEXTS = (_LONG, _MORE, _THIRD, _FOURTH, _LINKED, _MID)


def _run(n: int, first: str = "") -> list[str]:
    """n paragraphs, worded unlike each other."""
    return [f"{first}{k + 1}. {_TEXTS[k % len(_TEXTS)]}" for k in range(n)]


def _paragraphs(texts: list[str]) -> str:
    return "".join(f"<p>{t}</p>" for t in texts)


#: Parts of further pages: (markup, its article blocks). Every start goes with every article and every end.
_STARTS = [
    "",
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>",
    f"<header><div class='logo'>Town Paper</div><p>{_MID}</p></header>",
    "<div class='ad'>A bright new car waits for you.</div>",
    f"<div class='popup-wrap'><p>{_FOURTH}</p><p>Yes</p></div>",
    "<div><p>We keep small files on your device, so that we know you when you come again.</p><p>Agree</p></div>",
    "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News and more</a></li><li><a href='/t'>Town</a></li></ul>",
]
_ARTICLES = [
    (f"<article><h1>The flood</h1><p>{_LONG}</p><p>{_SHORT}</p></article>", ["The flood", _LONG, _SHORT]),
    (f"<article><h1>A wet year</h1><p>It was a wet year for all of us.</p><p>{_LINKED}</p></article>", ["A wet year", "It was a wet year for all of us.", _LINKED]),
    (f"<article><p>{_LONG}</p><p>Go.</p><p>{_MORE}</p></article>", [_LONG, "Go.", _MORE]),
    (f"<main><h2>After</h2><ul><li>Boots.</li><li><a href='/b'>Bread</a></li></ul><p>{_THIRD}</p><p>Over.</p></main>", ["After", "Boots.", "Bread", _THIRD, "Over."]),
    (f"<article><p>{_THIRD}</p><div class='social-history'><h3>Before</h3><p>{_LONG}</p></div></article>", [_THIRD, "Before", _LONG]),
    (f"<article class='post'><p>{_LONG}</p><div class='share-links'><a href='#'>Send it</a></div><p>{_THIRD}</p><aside><p>{_LINKED}</p></aside></article>", [_LONG, _THIRD]),
    (f"<article><p>{_LONG}</p><section id='search'><h2>The search</h2><p>{_MORE}</p><p>{_THIRD}</p></section></article>", [_LONG, "The search", _MORE, _THIRD]),
    (f"<article><h1>Prices</h1><p>{_THIRD}</p><ul><li><a href='/1'>Grain</a></li><li><a href='/2'>Salt and oil</a></li><li><a href='/3'>All prices of the week</a></li></ul><p>{_LONG}</p></article>", ["Prices", _THIRD, _LONG]),
    ("<article><h1>A hard frost</h1><p>A hard frost came.</p></article>", ["A hard frost", "A hard frost came."]),
    (f"<article><h1>Ice</h1>{_paragraphs(_run(5))}</article>", ["Ice", *_run(5)]),
    (f"<article>{_paragraphs(_run(9))}<p>So.</p>{_paragraphs(_run(2, 'Then '))}<p>It was over by noon.</p><p>Nobody.</p></article>", [*_run(9), "So.", *_run(2, "Then "), "It was over by noon.", "Nobody."]),
    (f"<article><h1>A wet year</h1>{_paragraphs(_run(40))}<p>{_SHORT}</p><p>Yes.</p>{_paragraphs(_run(2, 'Then '))}<p>And then it was over for that year.</p></article>", ["A wet year", *_run(40), _SHORT, "Yes.", *_run(2, "Then "), "And then it was over for that year."]),
    (f"<article>{_paragraphs(_run(24))}<section><h2>Later</h2>{_paragraphs(_run(3, 'Later '))}</section></article>", [*_run(24), "Later", *_run(3, "Later ")]),
    (f"<article><h1>Fish</h1><p>{_LONG}</p><p>{_MORE}</p><form class='search'><p>Look for fish</p></form><div class='tags'><a href='/f'>fish</a> <a href='/r'>river</a></div></article>", ["Fish", _LONG, _MORE]),
]
_ENDS = [
    "",
    "<footer>Imprint</footer>",
    f"<footer>{_paragraphs(_run(2, 'Our house '))}</footer>",
    f"<aside><h3>Seen</h3>{_paragraphs(_run(4, 'Seen '))}</aside>",
    "<footer><p>A long list of the people who have made this page, with all their names and houses.</p></footer>",
    "<div class='comments'><p>I was there that night, and I can tell you that nobody rang any bell at all.</p><p>No.</p></div>",
    "<form><p>Your name and your address</p><button>Send</button></form><p><a href='/x'>Next page</a></p>",
    "<article><p>That is what I think too, and so do all of my neighbours here.</p></article>",
    "<article><h3><a href='/n'>Another story</a></h3><p>Bread will be dearer next year.</p></article>",
    "<p>Somewhere below the article there is a line that belongs to nothing, as long as any other line of the page.</p>",
]
PAGES += [(f"<body>{start}{markup}{end}</body>", wanted) for start in _STARTS for markup, wanted in _ARTICLES for end in _ENDS if len(" ".join(wanted)) > 60 or end == "" or end[1:5] in ("foot", "asid", "form")]  # a short article beside other articles is not told apart
#: The same without an element that says where the article is; the elements that say so hold a comment, or the start of another story.
_PLAIN = [
    (f"<h1>The flood</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MORE}</p>", ["The flood", _LONG, _SHORT, _MORE]),
    (f"<div class='text'><p>{_THIRD}</p><p>{_LONG}</p><p>{_SHORT}</p></div>", [_THIRD, _LONG, _SHORT]),
    (f"<div class='search-history'><h2>After</h2><p>{_LINKED}</p><p>{_MORE}</p></div>", ["After", _LINKED, _MORE]),
    (f"<div><h1>Long</h1>{_paragraphs(_run(20))}</div>", ["Long", *_run(20)]),
    ("".join(f"<div><p>{t}</p></div>" for t in _run(12)), _run(12)),
    (f"<div class='story'><h1>Bells</h1><p>{_MORE}</p><p>{_LONG}</p><p>{_THIRD}</p></div>", ["Bells", _MORE, _LONG, _THIRD]),
]
PAGES += [(f"<body>{start}{markup}{end}</body>", wanted) for start in _STARTS for markup, wanted in _PLAIN for end in _ENDS[:-1]]

