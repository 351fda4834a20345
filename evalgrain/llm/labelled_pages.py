"""Labelled pages: the main text stands between OPEN and CLOSE. They teach which tags surround and fill an article."""

OPEN, CLOSE = "[[", "]]"

_PROSE = "The river rose for three days and the villagers moved their animals to the upper fields before the bridge closed."
_LINKS = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("home", "news", "sport", "weather", "contact"))

PAGES = (
    f'<!DOCTYPE html><html><head><title>Flood</title></head><body><nav><ul>{_LINKS}</ul></nav><div class="ad">Buy our '
    f'boots today</div><article>[[<h1>Flood</h1><p>{_PROSE}</p><p>{_PROSE} <b>{_PROSE}</b></p>]]</article>'
    '<footer>&copy; valley news</footer></body></html>',
    f'<html><body><header><h2>The Valley</h2><form><input name="q"><button>Search</button></form></header><div '
    f'class="sidebar"><ul>{_LINKS}</ul></div><main>[[<h1>Bridge</h1><p>{_PROSE}</p><ul><li>{_PROSE}</li><li>{_PROSE}</li>'
    f'</ul><p>{_PROSE}</p>]]</main><div class="comments"><p>nice text</p><p>I was there too</p></div><footer><p>All '
    'rights reserved</p></footer></body></html>',
    f'<html><body><div id="menu">{_LINKS}</div><div id="cookie-notice">We use cookies <button>OK</button></div><div '
    f'id="content">[[<h2>Fields</h2><p>{_PROSE}</p><blockquote>{_PROSE}</blockquote><p>{_PROSE}<br>{_PROSE}</p>]]</div>'
    f'<aside><h3>Related</h3><ul>{_LINKS}</ul></aside><div id="footer">imprint</div></body></html>',
    f'<html><body><table><tr><td class="nav">{_LINKS}</td><td>[[<p>{_PROSE}<p>{_PROSE}<p><i>{_PROSE}</i>]]</td></tr>'
    '</table><footer>contact</footer></body></html>',
    f'<html><body><nav>{_LINKS}</nav><section>[[<h1>Animals</h1><p>{_PROSE} <a href="/x">{_PROSE}</a></p><figure>'
    f'<figcaption>{_PROSE}</figcaption></figure><p>{_PROSE}</p>]]</section><section class="newsletter"><h3>Subscribe</h3>'
    '<form><input><button>Go</button></form></section></body></html>',
)

# Articles with data tables, code, lists of terms, figures and short paragraphs, in wrappers without a telling name.
_ROWS = "".join(f"<tr><th>{place}</th><td>{day}</td><td>{level}</td></tr>" for place, day, level in (
    ("Upper weir", "Monday", "2.4 m"), ("Old mill", "Monday", "1.9 m"), ("Stone bridge", "Tuesday", "3.1 m"),
    ("Ferry landing", "Wednesday", "2.8 m")))
RICH = (
    f'<html><body><nav>{_LINKS}</nav><div id="content">[[<h1>Water levels</h1><p>The gauges along the valley were read '
    f'twice a day, and the table lists the highest values.</p><table><caption>Highest levels</caption><thead><tr><th>Gauge'
    f'</th><th>Day</th><th>Level</th></tr></thead><tbody>{_ROWS}</tbody></table><p>None of them reached the mark of the '
    f'flood a century ago.</p>]]</div><footer><p>Water board, office hours by appointment</p></footer></body></html>',
    f'<html><body><header><a href="/">Field notes</a></header><section>[[<h1>Reading a gauge</h1><p>Each station writes '
    f'one line an hour.</p><h2>Format</h2><pre><code>station;time;centimetres\n14;06:00;231\n14;07:00;238</code></pre>'
    f'<p>Split at the semicolon.</p><p>Then sort by time.</p><h3>Gaps</h3><p>A missing hour has no line.</p><dl><dt>station'
    f'</dt><dd>number of the gauge on the map</dd><dt>centimetres</dt><dd>height above the zero of the gauge</dd></dl>'
    f'<hr><p>Questions go to the station master.</p>]]</section><aside>{_LINKS}</aside></body></html>',
    f'<html><body><nav>{_LINKS}</nav><main>[[<h1>Letters</h1><blockquote><p>We saw the water come.</p><p>We left.</p>'
    f'</blockquote><p>So wrote a farmer in spring.</p><figure><img src="a.png"><figcaption>The farm in May</figcaption>'
    f'</figure><ol><li>Call the neighbours.</li><li>Open the gates.</li><li>Leave by the upper road.</li></ol><table><tr>'
    f'<td>Animals moved</td><td>214</td></tr><tr><td>Animals lost</td><td>3</td></tr></table><p>It <em>could</em> have been '
    f'<strong>worse</strong>, said the <a href="/mayor">mayor</a>.</p>]]</main><footer><p>Letters may be shortened</p>'
    f'</footer></body></html>',
)

# Boxes around the text, and wrappers and blocks of the text that are called by the same words. They teach the words of
# classes only.
NAMED = (
    f'<html><body><div class="site has-sidebar sticky-header"><div class="masthead topbar">{_LINKS}</div><div class="'
    f'breadcrumbs skip-link">{_LINKS}</div><div class="post-wrap"><div class="article-header">[[<h1>Rain</h1><p>{_PROSE}'
    f'</p></div><div class="widget-text-editor"><p>{_PROSE}</p><p>{_PROSE}</p></div><div class="entry-meta-text"><p>'
    f'{_PROSE}</p></div>]]</div><div class="share social-links">{_LINKS}</div><div class="related recommended-posts"><p>'
    f'{_PROSE}</p>{_LINKS}</div><div class="sidebar rail"><div class="widget promo sponsored"><p>{_PROSE}</p></div></div>'
    f'<div class="pagination pager">{_LINKS}</div><div class="copyright legal disclaimer"><p>{_PROSE}</p></div></div>'
    f'<div class="cookie-consent gdpr popup modal overlay"><p>{_PROSE}</p></div><div class="login signup subscription"><p>'
    f'{_PROSE}</p></div><div class="respond replies discussion disqus"><p>{_PROSE}</p></div></body></html>',
)
