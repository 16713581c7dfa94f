from pyspark.sql import functions as F

from casework.functions import citations as cites
from casework.functions import text as txt
from casework.functions.pages import page_text
from casework.functions.sidecar import parse_sidecar


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_page_text(spark):
    html = "<nav>nav content</nav><script>alert('x')</script><p>body&nbsp;A &amp; B</p><header>h</header><head>t</head>"
    assert one(spark, txt.clean_text(page_text(F.lit(html)))) == "body A & B t"
    assert one(spark, txt.clean_text(F.lit("Page*12 of the case \n text."))) == "Page of the case text."


def test_years(spark):
    assert one(spark, txt.extract_year(F.lit("1958-03-01"), F.lit(""))) == "1958"
    assert one(spark, txt.extract_year(F.lit(""), F.lit("This case was decided in 1922."))) == "1922"
    assert one(spark, txt.extract_year(F.lit(None), F.lit("No date here."))) == "Unknown"
    assert one(spark, txt.fix_year(F.lit(" nan "))) == "Unknown"
    assert one(spark, txt.fix_year(F.lit("c. 1650?"))) == "1650"


def test_court_and_name(spark):
    text = F.lit("In the Supreme Court of Indiana the judges held")
    assert one(spark, txt.extract_court(F.lit(""), text)) == "Supreme Court of Indiana"
    name = txt.extract_case_name(F.lit(""), F.lit("Smith v. Jones appeared before the court."), F.lit("s"))
    assert one(spark, name) == "Smith v. Jones"
    assert one(spark, txt.extract_case_name(F.lit(None), F.lit("no pattern here"), F.lit("file_0001"))) == "file_0001"
    assert one(spark, txt.case_id_from_stem(F.lit("file_0001"))) == "0001"


def test_citations(spark):
    empty = F.lit("")
    assert "12 Conn. 345" in one(spark, cites.extract_citations(F.lit("See 12 Conn. 345 for the rule.")))
    assert one(spark, cites.extract_citations(F.lit("Cf. 347 U.S. 483 (1954)."))) == ["347 U.S. 483"]
    both = cites.extract_citations(F.lit("See 12 Conn. 345. Also 12 Conn. 345."), F.array(F.lit("12 Conn. 345")))
    assert one(spark, both) == ["12 Conn. 345"]
    assert one(spark, cites.extract_citations(empty, F.array(F.lit("Z Rep. 1"), F.lit("A Rep. 99")))) == ["A Rep. 99", "Z Rep. 1"]
    assert one(spark, cites.extract_citations(empty)) == []
    assert one(spark, cites.parse_citation_list(F.lit(None))) == []


def test_sidecar(spark):
    rows = [
        ('{"name":"A","court":{"name":"C"},"citations":[{"cite":"1 A. 1"},"skip"],"cites_to":["7 Ind. 200",{"cite":"2 B. 2"},{}]}',),
        ('{"court":"Plain"}',),
        ("not json",),
    ]
    out = parse_sidecar(spark.createDataFrame(rows, "json string"), "json").collect()
    assert (out[0].name, out[0].court_name, out[0].sidecar_citations) == ("A", "C", ["1 A. 1", "7 Ind. 200", "2 B. 2"])
    assert (out[1].name, out[1].court_name, out[1].sidecar_citations) == ("", "Plain", [])
    assert (out[2].name, out[2].court_name) == ("", "")


def test_small_functions(spark):
    assert one(spark, txt.truncate(F.lit("alpha beta gamma"), 12)) == "alpha beta"
    assert one(spark, txt.title_case(F.lit("the judgment'is straße"))) == "The Judgment'Is Straße"
    assert one(spark, txt.title_case(F.lit("ßa"))) == "Ssa"
    assert one(spark, txt.first_amount(F.lit("paid $1,200.00 then $3"))) == "$1,200.00"
    assert one(spark, txt.word_count(F.lit("  "))) == 0
    assert one(spark, txt.strip_accents(F.lit("Çà et là ø"))) == "Ca et la ø"


def test_entities_and_unclosed_elements(spark):
    from casework.functions.pages import page_text

    pages = {
        "&sect; 12 &#8217;s caf&eacute; &#x41;&amp;lt; &copy": "§ 12 ’s café A&lt; ©",
        "a&nbsp;b &notanentity; &": "a b ¬anentity; &",
        "before<script>if (a < b) {": "before",
        "x<STYLE type='t'>p {}</STYLE>y<nav>menu</nav>z": "xyz",
        "": "",
    }
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*pages, None])], "i int, page string")
    got = [r.t for r in df.orderBy("i").select(page_text(F.col("page")).alias("t")).collect()]
    assert got == [*pages.values(), None]
