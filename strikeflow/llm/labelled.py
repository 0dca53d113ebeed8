"""Labelled pages that the extraction model is trained on.

``data-y="1"`` marks content, ``data-y="0"`` other parts inside it; what is
not marked is no content.  The pages show the usual ways to build a page, with
texts of our own.
"""

_LONG = "The river had fallen by a hand's breadth since the morning, and the men on the bank were counting the stones that stood out of it. Nobody spoke of the mill, which had not turned for a week."
_MORE = "When the rain came back in autumn, the wheel turned again. The miller's daughter wrote the day into the book, as her father had done, and his."
_SHORT = "It did."
_LINKS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Contact</a></li></ul>'

PAGES = (
    f"<body><nav>{_LINKS}</nav><div class='ad'>Buy a new boat today. It floats.</div><article data-y='1'><h1>The mill</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MORE}</p></article><footer>&copy; The paper, all rights reserved.</footer></body>",
    f"<body><nav>{_LINKS}</nav><article data-y='1'><h1>Low water</h1><p>{_SHORT}</p></article><footer>Printed in town. Write to us.</footer></body>",
    f"<body><header><a href='/'>The Daily</a>{_LINKS}</header><main data-y='1'><h1>Low water</h1><p>{_LONG}</p><ul><li>One stone.</li><li>Two stones.</li></ul><p>{_MORE}</p></main><aside><h3>Related</h3>{_LINKS}</aside><footer><p>All rights reserved.</p></footer></body>",
    f"<body><div class='menu'>{_LINKS}</div><div id='content' data-y='1'><h2>Low water</h2><p>{_MORE}</p><div class='advert' data-y='0'>Boats at half the price. Call now.</div><p>{_LONG}</p></div><div id='footer'>Contact us. Imprint.</div></body>",
    f"<body><div class='page'><div class='sidebar'><p>Subscribe to our letter and hear from us every week, without fail.</p></div><div class='post' data-y='1'><h1>Mill</h1><p>{_LONG}</p><blockquote>{_MORE}</blockquote></div><div class='comments'><h3>Comments</h3><div class='comment'><p>{_MORE}</p></div><div class='comment'><p>I was there and saw it all. {_SHORT}</p></div></div></div></body>",
    f"<body><div class='cookie-notice'><p>We use cookies to make this page better. Accept them all.</p><button>Accept</button></div><article data-y='1'><header><h1>Mill</h1></header><p>{_LONG}</p><section><h2>Later</h2><p>{_MORE}</p></section><section id='comments' data-y='0'><p>{_LONG}</p><p>{_SHORT}</p></section></article></body>",
    f"<body><form action='/search'><label>Search</label><input><button>Go</button></form><article data-y='1'><p>{_SHORT}</p><p>{_MORE}</p><form data-y='0'><p>Your name and your address, please.</p><button>Send</button></form></article><footer><nav>{_LINKS}</nav></footer></body>",
    f"<body><div id='header'><h1><a href='/'>The Daily</a></h1></div><div class='wrap'><div class='story' data-y='1'><p>{_LONG}</p><p>{_MORE}</p><pre>12 stones</pre><table><tr><td>Monday</td><td>4 stones</td></tr></table></div><div class='share'><a href='/f'>Share</a></div></div></body>",
    f"<body><section data-y='1' class='entry-content'><h1>Autumn</h1><p>{_MORE}</p><p>{_SHORT}</p><figure><figcaption>The wheel in October.</figcaption></figure></section><section class='related-posts'><h2>More</h2><p><a href='/x'>Another mill that stands still, and why.</a></p></section></body>",
    f"<body><nav>{_LINKS}</nav><main><article data-y='1'><h1>Spring</h1><p>{_LONG}</p><aside class='promo' data-y='0'><p>Read our book about mills. It is out now.</p></aside><p>{_SHORT}</p><ol><li>{_MORE}</li><li>{_SHORT}</li></ol></article></main><div class='newsletter'><p>Get the letter.</p></div><footer><p>{_SHORT}</p></footer></body>",
    f"<body><div data-y='1'><h1>Plain page</h1><p>{_LONG}</p><p>{_MORE}</p></div></body>",
    f"<body><p data-y='1'>{_LONG}</p><p data-y='1'>{_MORE}</p></body>",
    f"<body><div class='banner'>Sale! Boats and oars.</div><nav>{_LINKS}</nav><div class='ad'>{_MORE}</div><article data-y='1'><h1>Ice</h1><p>Ice ### on *** the &amp;&amp; river %%% again</p><p>{_LONG}</p></article><footer>&copy; mill.example &middot; {_SHORT} {_MORE}</footer></body>",
    f"<body><nav>{_LINKS}</nav><div class='ad'>{_SHORT}</div><article data-y='1'><h1>Ice</h1><p>ice</p></article><footer>&copy; mill.example &middot; {_LONG}</footer></body>",
    f"<body><nav>{_LINKS}</nav><div class='ad'></div><article data-y='1'><h1>Old</h1><p><b>{_LONG}<br><p>{_SHORT}</p><p><a href='/m'>{_MORE}</a></p></article><footer></footer></body>",
    f"<body><div class='topbar'><p>{_MORE}</p></div><div class='main-content'><div class='article-body' data-y='1'><p>{_LONG}</p><h3>Notes</h3><p>{_MORE}</p></div></div><div class='site-footer'><p>{_LONG}</p></div></body>",
    f"<body><header><h1>The Daily</h1><a href='/'>x</a></header><aside class='sidebar'><h2>More</h2><p>{_LONG}</p></aside><article data-y='1'><h1>Ice</h1><p>{_SHORT}</p><p>{_LONG}</p></article><form><label>{_SHORT}</label><p>{_MORE}</p></form><footer><p>{_MORE}</p></footer></body>",
    f"<body><header><h1>The Daily</h1><p>News of the river, every day.</p></header><main data-y='1'><p>{_SHORT}</p><p>{_MORE}</p></main><footer>{_SHORT}</footer></body>",
    f"<body><header><div>The Daily</div><div>{_SHORT}</div></header><article data-y='1'><div><div><p>{_SHORT}</p></div><div>{_LONG}</div></div><div>{_SHORT}</div></article><footer>f</footer></body>",
    f"<body><nav>{_LINKS}</nav><article data-y='1'><div>{_LONG}</div><div>{_MORE}</div><div><h2>Notes</h2>{_SHORT}<p>{_MORE}</p></div></article><div class='ad'>{_LONG}</div></body>",
    f"<body><nav>{_LINKS}</nav><div class='content' data-y='1'><div>{_SHORT}</div><section><div>{_MORE}</div></section></div><div class='widget'>{_SHORT}</div></body>",
    f"<body><header><h1>The Daily</h1><nav>{_LINKS}</nav></header><article data-y='1'><h1>Ice</h1><p>{_LONG}</p><section class='comments' data-y='0'><h2>Comments</h2><ul><li>{_LONG}</li><li>{_SHORT}</li></ul></section></article></body>",
    f"<body><header><h1>The Daily</h1><p>{_SHORT}</p></header><p data-y='1'>{_MORE}</p><p data-y='1'>{_SHORT}</p><footer>{_LONG}</footer></body>",
    f"<body><nav>{_LINKS}</nav><div class='post-content' data-y='1'><h2>Ice</h2><div>{_LONG}</div><div>{_MORE}</div></div><div class='related'>{_SHORT}</div></body>",
    f"<body><div class='kopf'><div>Die Zeitung</div>{_LINKS}</div><div class='inhalt' data-y='1'><h1>Ice</h1><p>{_LONG}</p><p>{_MORE}</p></div><div class='fuss'><p>{_SHORT} Impressum.</p></div></body>",
    f"<body><div id='s1'><p>{_SHORT}</p></div><div id='s2'><div data-y='1'><h2>Ice</h2><p>{_MORE}</p><p>{_LONG}</p></div><div id='s4'>{_LINKS}</div></div><div id='s5'>{_SHORT} 2024</div></body>",
    f"<body><div class='cabecera'><a href='/'>El Diario</a></div><div class='texto' data-y='1'><h1>Ice</h1><p>{_LONG}</p><div>{_SHORT}</div><p>{_MORE}</p></div><div class='pie'>{_SHORT} Contacto.</div></body>",
    f"<body><article class='post' data-y='1'><h1>Ice</h1><p>{_MORE}</p><div class='ads' data-y='0'>Oars for all. Come and see.</div><div class='promo' data-y='0'><p>Read more of it. Now.</p></div><div>{_LONG}</div></article></body>",
    f"<body><nav>{_LINKS}</nav><article class='news-alert' data-y='1'><h1>Ice</h1><p>{_LONG}</p><p>{_SHORT}</p></article><div class='post-share'><a href='/f'>Share</a> it.</div><footer>{_SHORT}</footer></body>",
    f"<body><div class='site widget'><nav>{_LINKS}</nav><article data-y='1'><p>{_LONG}</p></article><div class='comments'><article class='comment'><p>{_MORE}</p></article><article class='comment'><p>{_SHORT}</p></article></div></div></body>",
)
