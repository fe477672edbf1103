"""Pages written and labelled for the body extractor: what stands in {{ }} is the page's own article.

Four invented sites with several pages each, so that what a site repeats can be counted.  Their furniture follows the layouts of common
publishing software; the wording is our own.  No weight is given to any word: see ``main_body``.
"""


def _wiki(title: str, article: str, after: str = "", box: str = "") -> str:
    """A team wiki that exports its pages."""
    return (
        f'<html><head><title>{title} - Gannet Works</title></head><body><div id="page"><div id="main-header"><div id="breadcrumb-section"><ol id="breadcrumbs">'
        f'<li><span><a href="index.html">Gannet Works</a></span></li><li><span><a href="team.html">Crew handbook</a></span></li></ol></div></div>'
        f'<div id="content" class="view"><div class="page-metadata">Started by <span class="author">m{len(title)} hale</span>, edited in May 20{len(article) % 30}</div>{{{{<h1 id="title-text">{title}</h1>{article}}}}}'
        f'{box}{after}</div></div><div id="footer" role="contentinfo"><section class="footer-body"><p>Exported by the archive job of Gannet Works at 7:{len(title)}</p></section></div></body></html>'
    )


_FILES = '<div class="pageSection group"><h2 id="attachments">Files on this page</h2><div class="greybox"><a href="a/{0}.odt">{0}.odt</a> <br/><a href="a/{0}-2.png">{0}-2.png</a></div></div>'
_ASK = '<div class="rating-box"><p>Did you find your answer here?</p><ul><li>It helped</li><li>It did not</li></ul></div>'
_TALK = '<div class="pageSection"><h3>Discussion</h3><p>{0} wrote: {1}</p><p>{2} wrote: {3}</p></div>'


def _lexicon(title: str, article: str, links: str, more: str = "") -> str:
    """An open lexicon with side panels."""
    return (
        f'<html><head><title>{title} - Peat Lexicon</title></head><body class="mediawiki"><div id="mw-panel"><h3>Wander</h3><ul><li><a href="/m">Front door</a></li><li><a href="/l">Surprise article</a></li>'
        f'<li><a href="/d">Give money</a></li></ul><h3>Workbench</h3><ul><li><a href="/u">Send a picture</a></li><li><a href="/s">Odd pages</a></li></ul></div><div id="siteNotice"><p>The Peat Lexicon asks its readers for '
        f'help with old maps until winter comes.</p></div><div id="content" class="mw-body" role="main">{{{{<h1 id="firstHeading">{title}</h1>{article}}}}}<h2>Elsewhere in the lexicon</h2><ul>{links}</ul>{more}'
        f'<div id="catlinks" class="catlinks"><a href="/c">Shelves</a>: <ul><li><a href="/c/{title[:3]}">{title[:3]} lists</a></li></ul></div></div>'
        f'<p class="printfooter">Text may be reused under the open meadow licence; some rules on top of it apply.</p><p>Peat Lexicon, copy number {len(article)}</p></body></html>'
    )


_CONTENTS = '}}}}<div id="toc" class="toc" role="navigation"><h2>In brief</h2><ul><li><a href="#p1">{0}</a></li><li><a href="#p2">{1}</a></li></ul></div>{{{{'


def _magazine(title: str, article: str, teasers: str, said: str = "") -> str:
    """A magazine with teasers, sharing buttons and remarks of readers."""
    return (
        f'<html><head><title>{title} | Tin Kettle</title></head><body><div class="q7"><p>Tin Kettle and 31 partners store data in your browser.</p><p>You can pick what is stored, today and later, under the '
        f'gear sign.</p></div><header><nav><ul class="menu"><li><a href="/n">Newest</a></li><li><a href="/w">Workshop</a></li><li><a href="/g">Garden</a></li><li><a href="/a">Write for us</a></li></ul></nav></header>'
        f'<main><article class="post"><p class="byline">By <a href="/who">our staff</a>, four minutes to read</p>{{{{<h1>{title}</h1>{article}}}}}</article></main>'
        f'<aside class="widget"><h4>Others also opened</h4>{teasers}</aside>{said}'
        f'<footer><ul><li><a href="/t">Terms</a></li><li><a href="/j">Jobs</a></li></ul><p>All rights with Tin Kettle, printed on screens since 19{len(title)}</p></footer></body></html>'
    )


_SHARE = '}}}}<div class="z5"><p>Pass it on</p><ul><li>By letter</li><li>By pigeon</li></ul></div>{{{{'
_LETTER = '}}}}<div class="box9"><p>Get the Tin Kettle letter every Friday</p></div>{{{{'


def _manual(title: str, article: str, side: str) -> str:
    """A manual made of plain tables."""
    return (
        f'<html><head><title>{title} - Rake manual</title></head><body><ul id="t1"><li><a href="/i">Index</a></li><li><a href="/x">Modules</a></li><li><a href="/p">Go back</a></li><li><a href="/q">Go on</a></li></ul>'
        f'<p><a href="/">Rake</a> / <a href="/2">Volume 2</a></p><table><tr><td>{{{{<h1>{title}</h1>{article}}}}}</td></tr></table><div class="r3"><h3>Shortcuts</h3><ul>{side}</ul><h3>Lately changed</h3>'
        f'<p>The handle of the rake is now listed with the other spare parts, as many had asked for it. <a href="/z">Go there</a></p><p>{title} is open for notes of the night crew again. <a href="/y">Go there</a></p></div>'
        f'<p>Rake manual, made with Drum 4.{len(title)}</p></body></html>'
    )


def _plain(title: str, article: str, before: str = "", after: str = "") -> str:
    """A site whose pages have no boxes at all."""
    return (
        f'<html><head><title>Loom guild: {title}</title></head><body><p><a href="/">Loom guild</a> - <a href="/up">Looms</a></p><ul><li><a href="/n1">Notices</a></li><li><a href="/n2">Shop</a></li><li><a href="/n3">Members</a></li></ul>{before}'
        f'{{{{<h1>{title}</h1>{article}}}}}{after}<p class="fine">The guild asks all members to send corrections by the first of the month.</p></body></html>'
    )


_PAPERS = '<h2>Papers:</h2><ul><li><a href="/f/{0}">{0}.doc</a></li><li><a href="/f/{0}2">{0}-plan.doc</a></li></ul>'
_STATE = '<ul class="t2"><li>Draft {0}</li><li>read {1} times</li></ul>'
_JOIN = '}}}}<p class="y1">Become a member of the guild and bring your own yarn to the meetings.</p>{{{{'

SITES = (
    (
        _plain("Warping", "<p>Warp the loom from left to right. Count the threads twice</p><h2>Warping the small loom</h2><p>It takes 240 threads <b>and one more</b></p><ul><li>Blue thread 120</li><li>Threads that slip must be tied again, since they never hold by themselves</li></ul>"
               "<h2>Warping: notes for winter</h2><div>\\[ n = 4 w \\]</div><p>Cold wool breaks.</p>", _STATE.format(3, 90), _PAPERS.format("warp")),
        _plain("Shuttle", "<h2>Summary for the crew</h2><p>A shuttle carries the weft. Ask the smith whether he has <code>shuttle 4</code> in stock</p>" + _JOIN + "<h2>Shuttle in oak</h2><ol><li>Cut the oak</li><li>Oil it</li></ol><h3>Shuttle in ash</h3><p>Ash is lighter but wears out sooner</p>", _STATE.format(12, 4411), _PAPERS.format("shuttle")),
        _plain("How to dye with onion skins", "<h2>Onion skins for the small pot</h2><p>Boil the skins for an hour; take them out: the water is brown now</p><table><tr><td>Wool</td><td>100</td></tr><tr><td>Skins of ten red onions</td><td>50</td></tr></table><p>See <a href='/w'>Washing wool</a> first.</p><div class='display'>$$d = m / 2$$</div>", after=_PAPERS.format("onion")),
        _plain("Washing wool", "<p>Use rain water.</p><h2>Summary for the crew</h2><p>Never wring it. Lay it on a cloth in the shade and leave it there for as long as it takes to dry</p>" + _JOIN + "<pre>wash 40\nrinse 20</pre>", _STATE.format(1, 7)),
        _plain("Loom of the north room", "<h2>Parts of the north room</h2><ul><li>Beam 1</li><li>Treadle<ul><li>Left treadle</li><li>Right treadle of the second loom</li></ul></li></ul><h2>Next steps for the beam</h2><p>It must be turned</p>", _STATE.format(40, 512)),
        _plain("Prices", "<p>A metre of linen costs $12 and a metre of wool costs $19.</p><h2>Linen</h2><p>See <a href='/l'>Linen</a>, <a href='/m'>Flax</a> and the <i>old list</i> before you buy some from anyone else than <b>Ruth</b>.</p>" + _JOIN + "<p>Prices rise in May.</p>", after=_PAPERS.format("prices")),
        _plain("Linen", "<h2>Summary for the crew</h2><p>Linen is made of flax</p>", _STATE.format(5, 33), _PAPERS.format("linen")),
    ),
    (
        _wiki("Tuning the pumps", "<p>The two pumps of the dock hall run at different speeds. Mark keeps the values in a table, which he checks on Fridays.</p><h2>Summary for the crew</h2><p>Turn the left valve first. "
              "When the needle rests, open the right one.</p><ul><li>Left pump: 40 strokes</li><li>Right pump: 38 strokes</li></ul>", _FILES.format("pumps")),
        _wiki("Who opens the gate", "<p>The early shift opens the gate.</p><p>On holidays the guard has the key. Ring twice and wait until she comes, for the bell is far from her room.</p>", _FILES.format("gate"), _ASK),
        _wiki("Paint stock", "<h2>Summary for the crew</h2><p>We have blue, grey and red paint. The red one is for the boats only.</p><table><tr><th>Colour</th><th>Litres</th></tr><tr><td>Blue</td><td>31</td></tr>"
              "<tr><td>Grey</td><td>12</td></tr></table><p>Order more when one of them falls below ten litres.</p>", _TALK.format("olga", "I counted nine litres of the grey one this morning, so somebody has to order", "finn", "done")),
        _wiki("Code of the crane", "<p>The crane runs this small program at night:</p><pre>lift 4\nturn 90\ndrop 4</pre><p>Do not change the second line unless the yard is empty.</p>", _TALK.format("bo", "Why not the third line", "olga", "Because the load would hang over the road all night, and that isn't allowed"), _ASK),
        _wiki("Summer party", "<h1>Summer party again</h1><p>It takes place behind the sheds.</p><h2>Summary for the crew</h2><ol><li>Bring a chair</li><li>Bring a cup<ul><li>not of glass</li></ul></li></ol>", _FILES.format("party"), _ASK),
        _wiki("Bolts", "<p>See <a href='nuts.html'>the list of nuts</a> for what goes with which bolt.</p><blockquote><p>Never force a bolt.</p></blockquote><div class='display'>$$k_1 = 8$$</div>", _ASK + _TALK.format("finn", "The long ones are out", "bo", "I put a box of them on the upper shelf below the window")),
    ),
    (
        _lexicon("Bog oak", _CONTENTS.format("Age", "Use") + "<p>Bog oak is wood that lay in a bog for a very long time. It is dark and hard, and carvers like it.</p><h2 id='p1'>Age</h2><p>Some trunks are older than 5000 years.</p>"
                 "<h2 id='p2'>Use</h2><ul><li>Pipes</li><li>Knife handles</li></ul>", '<li><a href="/1">Oak</a></li><li><a href="/2">Carving</a></li>'),
        _lexicon("Sphagnum", "<p>Sphagnum is a kind of moss. It holds up to twenty times its weight of water.</p><h2>Use</h2><div class='eq'>\\[ w = 20 m \\]</div><p>Gardeners put it into hanging baskets.</p>", '<li><a href="/3">Moss</a></li>'),
        _lexicon("Turf spade", _CONTENTS.format("Shape", "Makers") + "<p>A turf spade has a wing on its blade.</p><h2 id='p1'>Shape</h2><p>The wing cuts the second side of the block. With it one stroke is enough where others need two.</p>"
                 "<h2 id='p2'>Makers</h2><ol><li>Forge of Clon</li><li>Dunn and son</li></ol>", '<li><a href="/4">Spade</a></li><li><a href="/5">Turf cutting in the north</a></li>'),
        _lexicon("Bog cotton", "<p>Bog cotton grows on wet ground.</p><p>Its white heads carry the seeds.</p>", '<li><a href="/6">Cotton</a></li><li><a href="/7">Seeds that fly</a></li>'),
        _lexicon("Peat fire", "<p>A peat fire may burn for weeks below the ground, and rain does not put it out.</p><p>Its heat <i>h</i> follows <code>h = 3 * m</code>, where m is the mass.</p>", '<li><a href="/8">Fire</a></li>'),
        _lexicon("Drain", "<p>Drains lower the water level.</p><h2>Use</h2><p>They made room for fields, and the bog went dry within thirty years.</p>", '<li><a href="/9">Ditch</a></li>'),
    ),
    (
        _magazine("A shelf from one plank", "<p>You need a saw, a drill and an hour of time.</p>" + _SHARE + "<p>Saw the plank into three parts of 50 centimetres. Sand their edges until nothing catches on a cloth.</p><ul><li>4 hooks</li><li>1 plank</li></ul>",
                  '<p>The oil that saved our table was the cheapest of all. <a href="/b1">Open it</a></p><p>Nails or screws? We hung two doors to find out. <a href="/b2">Open it</a></p>'),
        _magazine("The slow tomato", "<p>Most people water their tomatoes too often.</p>" + _LETTER + "<p>Let the upper soil dry first. Then water the roots, not the leaves.</p><blockquote><p>My best plants had a bad summer.</p></blockquote>",
                  '<ul><li><a href="/b3">Seven beds for a small yard</a></li><li><a href="/b4">What snails avoid</a></li></ul>', '<div class="w2"><h3>Voices</h3><p>reader 52: Mine get water once a week and they are fine</p></div>'),
        _magazine("Why the kettle sings", "<h2>Bubbles</h2><p>Small bubbles form at the hot floor and break in the cold water above it. Each of them makes a tiny knock.</p>" + _SHARE + "<h2>Lime</h2><p>A crust of lime makes the kettle louder.</p>",
                  '<p>Tea from rain water, a test with four cups. <a href="/b5">Open it</a></p>', '<div class="w2"><h3>Voices</h3><p>reader 9: Ours has sung for years</p><p>reader 710: The crust goes away with vinegar, but you have to wait a night and rinse it well</p></div>'),
        _magazine("Knots for parcels", "<p>Three knots are enough for all parcels of a year.</p><pre>over, under, through</pre>" + _LETTER + "<p>Pull the free end and the whole thing comes loose.</p>",
                  '<ul><li><a href="/b6">Rope that does not swell</a></li></ul>'),
        _magazine("Old chairs", "<p>Turn the chair over and look at the joints.</p><ol><li>Loose joints get glue</li><li>Open cracks get a wedge</li></ol>" + _SHARE + _LETTER + "<p>Leave it alone for two days before anybody sits on it again.</p>",
                  '<p>Our reader built a bench from a door. <a href="/b7">Open it</a></p>', '<div class="w2"><h3>Voices</h3><p>reader 77: Two days was not enough for mine</p></div>'),
    ),
    (
        _manual("Setting the teeth", "<p>Set the teeth at 20 degrees.</p><h2>Steps to follow in order</h2><ol><li>Loosen screw 4</li><li>Bend the first tooth</li></ol><p>After that the rake pulls evenly on both sides.</p>", '<li><a href="/m1">Handle of ash</a></li><li><a href="/m2">Storing in winter</a></li>'),
        _manual("rake.conf", "<p>The file <code>rake.conf</code> is read once at the start. Write one value a line.</p><pre>teeth = 14\nangle = 20</pre><h2>Steps to follow in order</h2><p>Run the check before you save it.</p>", '<li><a href="/m3">Setting the teeth</a></li>'),
        _manual("Leaves and moss", "<div class='panel'><p>For moss use the short teeth.</p></div><p>Leaves need the long ones, and no force at all. Whoever pulls hard tears the lawn, and next year there will be more moss.</p>", '<li><a href="/m4">Lawn in spring</a></li><li><a href="/m5">Work order 7</a></li>'),
        _manual("Parts", "<table><tr><td>Tooth</td><td>14</td></tr><tr><td>Screw</td><td>28</td></tr></table><p>Parts are sold in packs of seven.</p>", '<li><a href="/m6">How to bend a tooth</a></li>'),
        _manual("Noise", "<h2>Steps to follow in order</h2><p>If the rake rattles, tighten every screw by a quarter turn.</p><p>For the force we have <span>\\(f = 2 t\\)</span> per tooth.</p>", '<li><a href="/m7">Parts</a></li>'),
    ),
)
