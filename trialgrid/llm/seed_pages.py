"""Labelled pages that the page model always learns from: y="1" marks the main text, y="0" what is not; children inherit."""

P = "<p>The committee met on Tuesday, and it agreed that the plan should go ahead, although two members asked for more time.</p>"
Q = "<p>Costs rose again last year. Most of the growth, the report says, came from transport, and little of it was planned.</p>"
LINKS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport</a></li></ul>'

SEEDS = [
    f'<body y="0"><header class="site-header"><h1>The Daily</h1><nav>{LINKS}</nav></header><article y="1"><h1>Plan agreed</h1>{P}{Q}<h2>Costs</h2>{P}<ul><li>First, the roads.</li><li>Then, the bridges.</li></ul></article><aside class="sidebar"><h3>Most read</h3>{LINKS}</aside><footer><p>Copyright 2020 The Daily. All rights reserved.</p></footer></body>',
    f'<body y="0"><div id="nav" class="menu">{LINKS}</div><div id="content"><div class="post-content" y="1"><h1>A walk</h1>{Q}{P}<blockquote>It was a long day, he said.</blockquote>{Q}</div><div class="comments"><h3>Comments</h3><div class="comment"><p>Great read, thanks for sharing this with us all.</p></div><form><textarea>Your comment</textarea><button>Send</button></form></div></div><div id="footer" class="footer"><p>Imprint, terms and privacy</p></div></body>',
    f'<body y="0"><div class="cookie-notice banner"><p>We use cookies, and by using the site you agree to this.</p><button>Accept</button></div><main><section class="article-body" y="1"><h2>Result</h2>{P}{P}<table><tr><td>One</td><td>Two</td></tr></table><div class="ad advert promo" y="0"><p>Buy now and save half.</p></div><figure><figcaption>The hall in May.</figcaption></figure>{Q}</section></main><div class="related"><h3>Related</h3>{LINKS}</div></body>',
    f'<body y="0"><nav class="breadcrumb"><a href="/">Home</a></nav><article y="1"><header><h1>Title of it</h1></header>{Q}<aside y="0" class="newsletter subscribe"><p>Sign up for our newsletter today.</p><form><input><label>Mail</label></form></aside>{P}<section id="comments" y="0"><ol><li class="comment reply"><p>I don\'t agree, and I said so before.</p></li></ol></section><footer y="0"><p>Posted in News, tagged plan</p><div class="share social">{LINKS}</div></footer></article><footer class="site-footer">{LINKS}</footer></body>',
    f'<body y="0"><div class="wrapper"><div class="top-bar header"><span>Log in</span></div><div class="main"><div class="entry text story" y="1">{P}{Q}<pre>x = 1\ny = 2</pre><dl><dt>Term</dt><dd>What it means, in short.</dd></dl></div><div class="widget sidebar">{LINKS}<p>Weather today: mild.</p></div></div><div class="notice alert message"><p>This site is closed on Monday.</p></div></div></body>',
    f'<body y="0"><div class="sponsor ad"><p>Our partner offers loans, and they are cheap.</p></div><div role="main" class="page"><h1 y="1">On the plan</h1><div y="1">{Q}{P}</div><div class="author-bio tags meta"><p>By a reporter</p></div><div class="pagination pager"><a href="2">Next</a></div></div><div role="contentinfo"><small>All rights reserved</small></div></body>',
]
