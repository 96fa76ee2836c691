"""Names, references, forms and parents of elements; texts and ranges against plain recursion."""

import random
import re
from html.parser import HTMLParser

import pytest

SPACE = re.compile(r"\s+")
PAGES = {
    1: """<body><span id=lbl>Account number</span><input id=i aria-labelledby=lbl aria-label=ignored placeholder="also ignored"></body>""",
    2: """<body><label for=i>Registration No.</label><input id=i><label>Password <input type=password name=pw value=x></label><input placeholder="Enter Aadhaar"></body>""",
    3: """<body><button>  Sign   in  </button><button><img alt="Download marksheet"></button><button>Save<span aria-hidden=true> (beta)</span></button><input type=submit><input type=submit value=Go></body>""",
    4: """<body><b id=a aria-label="First">x</b><i id=c>c</i><i id=a>second</i><input aria-labelledby=" c  nope a c " aria-describedby="c"></body>""",
    5: """<body><form><label>First Name<input name=f required></label><label>Last Name<input name=l></label><button>Register</button></form><label>Roll<input name=r></label>
          <form><label>Email<input type=email value="a b" name=e></label></form><a href=/h>Help</a></body>""",
    6: """<body><label>Dob<input name=dob aria-invalid=true aria-errormessage=err aria-describedby=d></label><p id=err>Too <b>young</b></p><p id=d>As on your card</p>
          <label>Pin<input name=pin aria-invalid=true aria-describedby=d></label><input name=n type=number value=9 max=5><input name=ok type=number value=4 max=5></body>""",
    7: """<body><label>Sem<select name=s><option>Semester 1<option selected value=5> Semester
          5 <option label="Other">ignored<option> </select></label><select name=m multiple><option>A</select><select name=d><option disabled>No<option>Yes</select></body>""",
    8: """<body><fieldset disabled><legend>Your <i>data</i></legend><input name=q></fieldset><table><caption>Marks</caption><tr><td>1<td>2</table><a href=/x>un<b>believ</b>able</a>
          <a href=/y><div>OUTR</div><cite>https://x</cite></a><button><svg><title>Search</title></svg></button></body>""",
    9: """<body><nav><div><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></div></nav><article><p><b>x<br><p>y</article></body>""",
    10: None, 11: "", 12: "no markup",
}


@pytest.fixture(scope="module")
def seen(spark):
    from palisade.operators import naming

    rows = naming.elements(spark.createDataFrame(list(PAGES.items()), "page_id long, html string")).orderBy("page_id", "n").collect()
    return {p: [r for r in rows if r.page_id == p] for p in PAGES}


def names(rows, *roles):
    return [r["name"] for r in rows if r.role in roles]


def by_field(rows):
    return {r.field_name: r for r in rows if r.tag in ("input", "select")}


def test_names(seen):
    assert names(seen[1], "textbox") == ["Account number"]
    assert names(seen[2], "textbox") == ["Registration No.", "Password", "Enter Aadhaar"]
    assert by_field(seen[2])["pw"].value is None
    assert names(seen[3], "button") == ["Sign in", "Download marksheet", "Save", "Submit", "Go"]
    assert [(r["name"], r.description) for r in seen[4] if r.tag == "input"] == [("c First c", "c")]
    assert names(seen[8], "link") == ["unbelievable", "OUTR https://x"]
    assert names(seen[8], "group", "table", "button") == ["Your data", "Marks", "Search"]


def test_forms_and_complaints(seen):
    five = {r["name"]: r for r in seen[5] if r.tag in ("input", "button", "a")}
    assert {k: r.form_id for k, r in five.items()} == {"First Name": 1, "Last Name": 1, "Register": 1, "Roll": 0, "Email": 2, "Help": None}
    assert five["First Name"].required and not five["Last Name"].required
    assert (five["Email"].invalid, five["Email"].message) == (True, "the value is not accepted")
    six = by_field(seen[6])
    assert {k: (r.invalid, r.message) for k, r in six.items()} == {
        "dob": (True, "Too young"), "pin": (True, "As on your card"), "n": (True, "the value is not accepted"), "ok": (False, None),
    }
    assert by_field(seen[8])["q"].disabled


def test_options(seen):
    got = by_field(seen[7])
    assert got["s"].options == ["Semester 1", "Semester 5", "Other"] and got["s"].value.split() == ["Semester", "5"]
    assert (got["m"].options, got["m"].value, got["d"].value) == (["A"], None, "Yes")


def test_parents(seen):
    # a paragraph without words of its own has no row
    role = {r.n: r.role for r in seen[9]}
    assert [(r.role, role.get(r.parent)) for r in seen[9]] == [
        ("navigation", None), ("list", "navigation"), ("listitem", "list"), ("link", "listitem"), ("listitem", "list"), ("link", "listitem"), ("article", None), ("generic", "article"),
        ("paragraph", "article"),
    ]
    assert [len(seen[p]) for p in (10, 11, 12)] == [0, 0, 0]


class Plain(HTMLParser):
    """A tree of well-formed markup, for reading texts by recursion."""

    def __init__(self):
        super().__init__()
        self.nodes, self.open = [], []

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs), [])
        if self.open:
            self.open[-1][2].append(node)
        self.nodes.append(node)
        if tag not in ("br", "img"):
            self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def spoken(node, depth=0):
    if depth > 12:
        return ""
    out = ""
    for c in node[2]:
        if isinstance(c, str):
            out += c
        elif c[1].get("aria-hidden") == "true":
            continue
        elif c[0] == "br":
            out += " "
        elif c[0] == "img":
            out += f" {c[1]['alt']} " if c[1].get("alt") else ""
        else:
            inner = spoken(c, depth + 1)
            out += inner if c[0] in ("b", "i", "span") or not inner else f" {inner} "
    return out


def whole(node):
    return "".join(c if isinstance(c, str) else whole(c) for c in node[2])


def random_markup(rng, depth=0):
    out = []
    for _ in range(rng.randint(0, 4)):
        k = rng.random()
        if k < 0.35 or depth > 18:
            out.append(rng.choice(["x", "yz", " ", "w "]))
        elif k < 0.42:
            out.append(rng.choice(["<br>", "<img alt=p>", "<img>"]))
        else:
            tag, hide = rng.choice(["b", "i", "span", "div", "section"]), " aria-hidden=true" if rng.random() < 0.1 else ""
            out.append(f"<{tag}{hide}>{random_markup(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_texts_equal_recursion(spark):
    from palisade.operators import naming
    from palisade.sources.stored import stored
    from palisade.sources.tree import trees

    rng = random.Random(5)
    deep = "<body>" + "".join(f"<div>{k}<span>s</span>" for k in range(30)) + "</div>" * 30 + "</body>"
    html = {k: f"<body>{random_markup(rng)}{random_markup(rng)}</body>" for k in range(150)} | {999: deep}
    rows = stored(trees(spark.createDataFrame(list(html.items()), "page_id long, html string")), "trees")
    flat = lambda s: SPACE.sub(" ", s).strip()
    heard = {(r.page_id, r.ord): flat(r.body) for r in naming.heard_text(rows, rows.select("page_id", "ord")).collect()}
    all_text = {(r.page_id, r.ord): r.body for r in naming.whole_text(rows, rows.select("page_id", "ord", "last")).collect()}
    n = 0
    for page, text in html.items():
        p = Plain()
        p.feed(text)
        for k, node in enumerate(p.nodes):
            assert heard.get((page, k), "") == flat(spoken(node)), (page, k)
            assert all_text.get((page, k), "") == whole(node), (page, k)
            n += 1
    assert n > 500


def test_ranges_hold_exactly_their_points(spark):
    from palisade.sources.tree import inside

    rng = random.Random(3)
    points = [(p, rng.randrange(300)) for p in range(4) for _ in range(60)]
    ranges = [(p, a, min(299, a + rng.choice([0, 1, 2, 7, 100, 299]))) for p in range(4) for a in rng.sample(range(300), 40)] + [(1, 5, 4)]
    got = sorted(map(tuple, inside(spark.createDataFrame(points, "page_id long, at int"), spark.createDataFrame(ranges, "page_id long, ord int, last int")).collect()))
    assert got == sorted((p, x, a, b) for p, x in points for q, a, b in ranges if p == q and a <= x <= b)


def test_form_fields_with_cut_references(spark, tmp_path):
    import duckdb

    from palisade.queries import ORACLE, QUERIES

    heads = ["A &amp; b&amp", "A &amp;&am", "&quot;q&quot; &lt;x&gt; &lt", "plain", "&amp;lt; &"]
    pages = [(k, f'<html><head><title>{h}</title></head><body><nav><ul><li><a href="/a?b=1&c=2">T{k}&amp;&quot</a></li><li><a href="/z">Z</a></li></ul></nav><article><h1>{h}</h1><p>x</p></article></body></html>') for k, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    found = QUERIES["form_fields"](spark, f"file://{tmp_path}")
    columns = ", ".join(f'"{c}"' for c in found.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT {columns} FROM ({ORACLE['form_fields']})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
