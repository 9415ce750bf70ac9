"""Column functions on hand-made edge rows (the driver tables lack these values)."""
import pytest
from pyspark.sql import functions as F

from laborlake.functions import lists, messages, salary, text
from laborlake.operators.tracking import pct_tenths


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_clean_salary_cases(spark):
    vals = ["160000.0", "54217.83", "$123,456/yr", "1.2.3", ".5", "-5", "", None, "n/a",
            "$100,000 - $120,000", "1" * 20]
    got = one_col(spark, vals, salary.clean_salary)
    assert got == [160000, 54217, 123456, 1, None, 5, None, None, None, 100000120000, None]


def test_to_usd_and_floor(spark):
    df = spark.createDataFrame([("3000000", "adzuna_in"), ("100000", "adzuna_gb"), ("4000", "adzuna_us"),
                                ("abc", "remotive"), (None, "remotive"), ("90000", "other")], "s string, src string")
    got = [r[0] for r in df.select(salary.to_usd("s", "src")).collect()]
    assert got == [round(3000000 / 95.0, 2), 127000.0, None, None, None, 90000.0]


def test_pay_band(spark):
    got = one_col(spark, [20000, 10000, 0, -10000, -10001], salary.pay_band, "bigint")
    assert got == ["above_market", "at_market", "at_market", "at_market", "below_market"]


MATCH_CASES = [("Senior Data Engineer", ["Data Engineer"], True),
               ("Engineer, Data Platform", ["Data Engineer"], True),
               ("Sales Jedi", ["Data Engineer"], False),
               ("Freelance Copywriter", ["Data Engineer"], False),
               ("Anything At All", [], True),
               ("SENIOR DATA ENGINEER", ["data engineer"], True)]


def test_match_terms_reference_cases(spark):
    df = spark.createDataFrame([(t, terms) for t, terms, _ in MATCH_CASES], "title string, terms array<string>")
    got = [r[0] for r in df.select(text.match_terms("title", "terms")).collect()]
    assert got == [k for _, _, k in MATCH_CASES]


def test_extract_skills_vocabulary_order(spark):
    df = spark.createDataFrame([("Senior Data Engineer", "We use PySpark, SQL and python on AWS; JavaScript only"),
                                ("Java dev", "k8s and Postgres, React.js"),
                                (None, None)], "t string, d string")
    got = [r[0] for r in df.select(text.extract_skills("t", "d")).collect()]
    assert got[0] == ["Python", "SQL", "Spark", "AWS"]
    assert got[1] == ["Kubernetes", "React", "PostgreSQL", "Java"]
    assert got[2] == []


def test_seniority_and_remote(spark):
    df = spark.createDataFrame([("Sr. Engineer", None, "adzuna_us"), ("Graduate Analyst", "lead the team", "adzuna_us"),
                                ("Engineer", "Our principal architect", "adzuna_us"),
                                ("Engineer", "x" * 500 + " senior", "remotive"),
                                ("Work-from-home Engineer", None, "adzuna_gb")], "t string, d string, s string")
    rows = df.select(text.infer_seniority("t", "d"), text.is_remote("s", "t", "d"),
                     text.infer_seniority("t", "d", description_chars=400)).collect()
    assert [r[0] for r in rows] == ["senior", "junior", "senior", "senior", "mid"]
    assert [r[2] for r in rows] == ["senior", "junior", "senior", "mid", "mid"]
    assert [r[1] for r in rows] == [False, False, False, True, True]


def test_month_from_iso(spark):
    got = one_col(spark, ["2024-03-05T10:00:00Z", "2024-1", None, "bad"], text.month_from_iso)
    assert got == [3, 1, None, None]   # "2024-1"[5:7] == "1"


LATEX = r"""\documentclass[11pt]{article}
\usepackage{geometry}
% a private comment
\begin{document}
\begin{center}
\textbf{Jane Doe} $\cdot$ jane@example.com
\end{center}
\section{Experience}
\begin{itemize}
\item Built \emph{Spark} pipelines, 50\% faster
\end{itemize}
\section*{Skills}
Python, SQL
\end{document}"""


def test_strip_markup_resume(spark):
    out = one_col(spark, [LATEX], text.strip_markup)[0]
    for word in ("Jane Doe", "Experience", "Spark", "Skills", "Python, SQL", "50% faster"):
        assert word in out
    assert "\\" not in out and "{" not in out and "}" not in out
    assert "$$" not in out and "private comment" not in out
    assert "- Built Spark pipelines" in out


@pytest.mark.parametrize("source, plain", [
    (r"\textbf{a \emph{b}} c", "a b c"),
    (r"10\% of it % not this" + "\nnext", "10% of it \nnext"),
    (r"\href{http://x}{the page}~here", "the page here"),
    (r"a $x_1$ b $ c", "a · b $ c"),
    (r"\section{One}" + "\n\n\n\n" + r"\item two\newline three", "One\n\n- two\n three"),
    (r"\unknown[opt]{gone} R\&D {kept}", "R&D kept"),
    ("plain  text", "plain text"),
    ("", ""),
    (None, None),
])
def test_strip_markup_cases(spark, source, plain):
    df = spark.createDataFrame([(source,)], "s string")
    assert df.select(text.strip_markup("s").alias("p")).first()["p"] == plain


def test_strip_tags(spark):
    html = "<html><head><style>p{}</style><script>var a='<p>';</script></head><body><!-- c --><p>A &amp; B</p></body>"
    assert one_col(spark, [html], text.strip_tags) == ["A & B"]


def test_intake_format(spark):
    df = spark.createDataFrame([("resume.tex", 10), ("cv.TXT", 5), ("old.doc", 5), ("x.pages", 5),
                                ("a.pdf", 0), ("b.pdf", 6 * 1024 * 1024)], "n string, s long")
    fmt, err = messages.intake_format("n", "s")
    rows = df.select(fmt, err).collect()
    assert [r[0] for r in rows] == ["tex", "txt", None, None, "pdf", "pdf"]
    assert rows[0][1] is None and rows[1][1] is None
    assert ".docx" in rows[2][1] and rows[3][1].startswith("Unsupported file type")
    assert rows[4][1] == "Empty file" and rows[5][1] == "File larger than 5 MB"


def test_header_map_last_wins(spark):
    df = spark.createDataFrame([([("Subject", "a"), ("From", "x@y"), ("SUBJECT", "b")],)],
                               "h array<struct<name:string,value:string>>")
    m = df.select(messages.header_map("h").alias("m")).first()["m"]
    assert m == {"from": "x@y", "subject": "b"}


def test_base64url_and_fences(spark):
    import base64
    raw = "héllo wörld?>"
    enc = base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")
    assert one_col(spark, [enc], messages.decode_base64url) == [raw]
    got = one_col(spark, ['```json\n{"k": 1}\n```', '{"k": 2}', "nope"],
                  lambda c: messages.parse_labelled_json(c, "k int")["k"])
    assert got == [1, 2, None]


def test_lists(spark):
    assert one_col(spark, ["Python, SQL ,, spark", None], lambda c: F.array_join(lists.csv_list(c), "|")) == \
        ["python|sql|spark", ""]
    assert one_col(spark, ["True", "t", "1", "false", None], lists.bool_text) == [True, True, True, False, False]
    got = one_col(spark, ["in, GB,xx", None], lambda c: F.array_join(lists.country_regions(c), ","))
    assert got == ["India,Europe,Remote", "Remote"]


def test_pct_tenths_half_even(spark):
    df = spark.createDataFrame([(1, 16), (3, 16), (1, 3), (0, 0), (5, 5)], "n long, d long")
    got = [r[0] for r in df.select(pct_tenths(F.col("n"), F.col("d"))).collect()]
    assert got == [6.2, 18.8, 33.3, 0.0, 100.0]
