"""Pages of makes that the tables don't have, with the blocks that are article marked by hand: ``+`` before an article block's line,
``-`` before any other. The markup around them was written for this test."""

LONG = "The river rose for three days after the storm and the lower town was closed to all traffic until the weekend"
MORE = "Volunteers filled bags with sand while the council met in the old school to plan the next steps for everyone"
LAST = "By Sunday the water had fallen again and the first shops along the quay could open their doors to customers"


def page(*parts):
    """(html, [(text, is article)]) of parts that are markup, or (mark, text)."""
    html, blocks = "", []
    for p in parts:
        if isinstance(p, tuple):
            mark, text = p
            html += text
            blocks.append((text, mark == "+"))
        else:
            html += p
    return html, blocks


PAGES = {
    "unnamed containers": page(
        "<html><head><title>x</title></head><body><div><ul><li><a href=/>", ("-", "Start"), "</a></li><li><a href=/n>", ("-", "News"), "</a></li><li><a href=/s>", ("-", "Sport"), "</a></li></ul></div>",
        "<div><h1>", ("+", "The flood"), "</h1><p>", ("+", LONG), "</p><h2>", ("+", "What helped"), "</h2><ul><li>", ("+", "Sand bags"), "</li><li>", ("+", "Pumps"), "</li></ul><p>", ("+", MORE), "</p><p>", ("+", "It worked."), "</p><p>", ("+", LAST), "</p></div></body></html>",
    ),
    "blog with a sidebar and comments": page(
        "<body class='home blog'><div id=masthead><p>", ("-", "A blog about the river and the people who live beside it"), "</p></div><div class='hentry'><h2>", ("+", "High water"), "</h2><div class='entry-content'><p>", ("+", LONG), "</p><blockquote>", ("+", "Never seen such a thing"), "</blockquote><p>", ("+", MORE), "</p></div></div>",
        "<div id=secondary class='widget-area sidebar'><h3>", ("-", "Recent posts"), "</h3><ul><li><a href=1>", ("-", "Low water and what it means"), "</a></li></ul></div><div id=comments class='comments-area'><p>", ("-", "Thank you for this report, we were worried about our cousins in the lower town"), "</p></div></body>",
    ),
    "news with a caption, an advert and a footer": page(
        "<header class='site-header'><a href=/>", ("-", "The Daily Ford"), "</a></header><main><h1>", ("+", "Quay open again"), "</h1><p>", ("+", LAST), "</p><figure><img src=a><figcaption>", ("+", "The quay on Sunday"), "</figcaption></figure><p>", ("+", MORE), "</p><aside class='promo'><p>", ("-", "Read all our reports for a small monthly fee and support the writers of this town"), "</p></aside><p>", ("+", LONG), "</p></main>",
        "<footer><p>", ("-", "All rights reserved by the publishers of this paper and its sister papers in the county"), "</p></footer>",
    ),
    "notice and form": page(
        "<div class='cookie-notice'><p>", ("-", "We use small files on your device to learn what you read and to show you more of it"), "</p></div><article><h1>", ("+", "Plan for the bank"), "</h1><p>", ("+", MORE), "</p><table><tr><td>", ("+", "Week one"), "</td><td>", ("+", "Measure"), "</td></tr><tr><td>", ("+", "Week two"), "</td><td>", ("+", "Build"), "</td></tr></table><p>", ("+", LAST), "</p></article>",
        "<form action=/s><p>", ("-", "Leave your address and we will write to you whenever something new appears"), "</p></form>",
    ),
    "old table layout": page(
        "<table><tr><td><a href=a>", ("-", "Home"), "</a></td></tr><tr><td><a href=b>", ("-", "Archive"), "</a></td></tr></table><div><h3>", ("+", "Notes from the quay"), "</h3><p>", ("+", LONG), "</p><p>", ("+", LAST), "</p></div><div><a href=c>", ("-", "Back to the top"), "</a></div>",
    ),
    "manual": page(
        "<nav class=toc><ol><li><a href=1>", ("-", "Setting up"), "</a></li><li><a href=2>", ("-", "Running"), "</a></li></ol></nav><section class=content><h1>", ("+", "Pumps"), "</h1><p>", ("+", MORE), "</p><pre>", ("+", "pump --start now"), "</pre><p>", ("+", "Then wait."), "</p><dl><dt>", ("+", "Flow"), "</dt><dd>", ("+", "Litres in a second"), "</dd></dl><p>", ("+", LONG), "</p></section>",
        "<div class=pager><a href=3>", ("-", "Next chapter"), "</a></div>",
    ),
    "shared story with related links": page(
        "<div class=story-body><h1>", ("+", "Three days of rain"), "</h1><p>", ("+", LONG), "</p><div class='social share'><ul><li><a href=x>", ("-", "Send"), "</a></li><li><a href=y>", ("-", "Print"), "</a></li></ul></div><p>", ("+", MORE), "</p><p>", ("+", LAST), "</p></div><div class='related'><h4>", ("-", "More on this"), "</h4><ul><li><a href=z>", ("-", "How the dam was built"), "</a></li></ul></div>",
    ),
}
