"""Random well-formed mails, parsed again by building a tree with the standard library."""

import random
from html.parser import HTMLParser

from mailquill.operators.explode import explode_alerts
from mailquill.schema import MAIL_SCHEMA

VOID = {"br", "img"}
TEXTS = [
    "word", " two words ", "\n", "a &amp; b", "&lt;h3&gt;", "x < 1", "&eacute;t&#233;", "&nbsp;", "&hellip;", "1 &amp;lt; 2",
    "R&D", "é à", "gse_alrt_title", "&#8211;&#x2013;", "tab\tin", "&unknown;", "a=b 'c' \"d\"",
]
CLASSES = ["gse_alrt_title", "gse_alrt_sni", "big gse_alrt_title", "gse_alrt_sni x", "other", "gse_alrt_snippet"]
HREFS = ["u", "u?a=1&amp;b=2", "", " v ", "w>x", "it's"]


class Node:
    def __init__(self, name, attributes, parent):
        self.name, self.attributes, self.parent, self.children = name, attributes, parent, []

    def walk(self):
        for child in self.children:
            yield child
            if isinstance(child, Node):
                yield from child.walk()

    def has_class(self, token):
        return token in (self.attributes.get("class") or "").split()

    def text(self):
        return "".join(child.strip() for child in self.walk() if isinstance(child, str))


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.name != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_comment(self, data):
        self.at.children.append(Node("comment", {}, self.at))

    def handle_data(self, data):
        if self.at.name in ("script", "style"):
            return
        if self.at.children and isinstance(self.at.children[-1], str):
            data = self.at.children.pop() + data
        self.at.children.append(data)


def expected(body):
    tree = Tree()
    tree.feed(body)
    tree.close()
    articles = []
    headings = [node for node in tree.root.walk() if isinstance(node, Node) and node.name == "h3"]
    for position, heading in enumerate(headings):
        anchors = [n for n in heading.walk() if isinstance(n, Node) and n.name == "a" and n.has_class("gse_alrt_title")]
        if not anchors:
            continue
        summary = ""
        siblings = [n for n in heading.parent.children if isinstance(n, Node) and n.name != "comment"]
        for sibling in siblings[siblings.index(heading) + 1 :]:
            if sibling.name == "h3":
                break
            if sibling.name == "div" and sibling.has_class("gse_alrt_sni"):
                summary = sibling.text()
                break
        title, link = anchors[0].text(), anchors[0].attributes.get("href") or ""
        if title and link:
            articles.append((position, title, link, summary))
    return articles


class Maker:
    def __init__(self, seed):
        self.random = random.Random(seed)

    def attribute(self, name, value):
        quote = "'" if '"' in value or self.random.random() < 0.4 else '"'
        if quote in value:
            quote = '"'
        name = self.random.choice([name, name.upper()])
        return f" {name}{self.random.choice(['=', ' = '])}{quote}{value}{quote}"

    def attributes(self, *extra):
        found = [self.attribute(*pair) for pair in extra]
        if self.random.random() < 0.3:
            found.append(self.attribute("style", "a:b;c>d"))
        if self.random.random() < 0.2:
            found.append(" hidden")
        self.random.shuffle(found)
        return "".join(found)

    def text(self):
        return self.random.choice(TEXTS)

    def inline(self, depth=0):
        parts = []
        for _ in range(self.random.randint(0, 4)):
            kind = self.random.random()
            if kind < 0.5 or depth > 2:
                parts.append(self.text())
            elif kind < 0.6:
                parts.append("<br>")
            elif kind < 0.7:
                parts.append("<!-- <h3> " + self.random.choice(["x", "</div>", "gse_alrt_sni"]) + " -->")
            else:
                name = self.random.choice(["b", "i", "sub", "B"])
                parts.append(f"<{name}{self.attributes()}>{self.inline(depth + 1)}</{name}>")
        return "".join(parts)

    def anchor(self):
        pairs = [("class", self.random.choice(CLASSES))]
        if self.random.random() < 0.9:
            pairs.append(("href", self.random.choice(HREFS)))
        return f"<a{self.attributes(*pairs)}>{self.inline(1)}</a>"

    def heading(self):
        inside = "".join(self.random.choice([self.text, self.anchor, self.anchor])() for _ in range(self.random.randint(0, 3)))
        name = self.random.choice(["h3", "h3", "H3"])
        return f"<{name}{self.attributes()}>{inside}</{name}>"

    def div(self, depth):
        inside = "".join(
            self.div(depth + 1) if self.random.random() < 0.3 and depth < 3 else self.inline(1)
            for _ in range(self.random.randint(0, 3))
        )
        name = self.random.choice(["div", "div", "DIV"])
        return f"<{name}{self.attributes(('class', self.random.choice(CLASSES)))}>{inside}</{name}>"

    def body(self):
        parts = ["<style>h3{} .gse_alrt_title{}</style>"] if self.random.random() < 0.3 else []
        for _ in range(self.random.randint(1, 8)):
            kind = self.random.random()
            if kind < 0.4:
                parts.append(self.heading())
            elif kind < 0.8:
                parts.append(self.div(0))
            elif kind < 0.9:
                parts.append(f"<div{self.attributes()}>" + self.heading() + self.div(1) + "</div>")
            else:
                parts.append(self.inline())
        return "".join(parts)


def nested_heading_between(body):
    """Headings inside a ``div`` beside another heading end the search here, but not in a tree."""
    tree = Tree()
    tree.feed(body)
    return any(
        isinstance(node, Node) and node.name == "h3" and node.parent is not tree.root for node in tree.root.walk()
    )


def test_random_mails(spark):
    bodies = [body for body in (Maker(seed).body() for seed in range(4000)) if not nested_heading_between(body)]
    assert len(bodies) > 2000
    mail = spark.createDataFrame([(str(at), "", "", "", 0.0, body) for at, body in enumerate(bodies)], MAIL_SCHEMA)
    found = {}
    for row in explode_alerts(mail.repartition(8)).collect():
        found.setdefault(int(row.email_id), []).append((row.position, row.title, row.link, row.summary))
    wrong = [
        (body, sorted(found.get(at, [])), expected(body))
        for at, body in enumerate(bodies)
        if sorted(found.get(at, [])) != expected(body)
    ]
    assert not wrong, (len(wrong), wrong[:3])
    assert sum(len(rows) for rows in found.values()) > 500
