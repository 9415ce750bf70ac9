"""Mail and upload helpers as column / frame functions: header maps, MIME body choice,
fenced-JSON parsing and upload-format detection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for identical results) -------------------
MAX_UPLOAD_BYTES = 5 * 1024 * 1024
LEGACY_DOC_ERROR = "Legacy .doc isn't supported. Save as .docx or .pdf and upload again."
UNSUPPORTED_ERROR = "Unsupported file type: {name}. Use .tex, .pdf, .docx, or .txt"
EMPTY_ERROR = "Empty file"
TOO_LARGE_ERROR = "File larger than 5 MB"
# ---------------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def header_map(headers) -> Column:
    """array<struct<name, value>> → map<lower(name), value>; a later header of the same
    (case-insensitive) name wins."""
    h = _c(headers)
    n = F.size(h)
    last = F.filter(h, lambda e, i: ~F.exists(F.slice(h, i + 2, F.greatest(n - i - 1, F.lit(1))),
                                              lambda x: F.lower(x["name"]) == F.lower(e["name"]))
                    | (i == n - 1))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["name"]).alias("k"),
                                                                   e["value"].alias("v"))))


def decode_base64url(data) -> Column:
    """base64url (``-``/``_``, padding stripped) → UTF-8 text (invalid bytes replaced)."""
    d = F.translate(_c(data), "-_", "+/")
    padded = F.concat(d, F.substring(F.lit("==="), 1, F.pmod(-F.length(d), F.lit(4))))
    return F.decode(F.unbase64(padded), "UTF-8")


def mime_body(parts: DataFrame, key: str = "message_id", max_chars: int | None = None) -> DataFrame:
    """Body text per message from a flattened part tree (``ord`` = depth-first position,
    bodies on leaves): the first part in depth-first order that is ``text/plain`` or
    ``text/html`` with data, decoded, whole unless ``max_chars`` bounds it; none → ''."""
    cand = parts.filter(F.col("mime_type").isin("text/plain", "text/html")
                        & F.col("data").isNotNull() & (F.col("data") != ""))
    first = cand.groupBy(key).agg(F.min(F.struct("ord", "data")).alias("p"))
    body = decode_base64url(F.col("p.data"))
    body = body if max_chars is None else F.substring(body, 1, max_chars)
    msgs = parts.select(key).distinct()
    return msgs.join(first.select(key, body.alias("body")), key, "left") \
               .select(key, F.coalesce("body", F.lit("")).alias("body"))


def strip_fences(col) -> Column:
    """Model answers wrapped in ``` fences: keep the text between the first two fences,
    minus a leading ``json`` tag."""
    s = F.trim(_c(col))
    inner = F.element_at(F.split(s, "```", -1), 2)
    inner = F.trim(F.regexp_replace(inner, r"^json", ""))
    return F.when(F.startswith(s, F.lit("```")), inner).otherwise(s)


def parse_labelled_json(col, schema: str) -> Column:
    """Fenced or bare JSON → struct (unparseable → NULL)."""
    return F.from_json(strip_fences(col), schema, {"mode": "PERMISSIVE"})


def intake_format(name, size) -> tuple[Column, Column]:
    """Upload classification by file extension and size: (format, error)."""
    n = F.lower(F.coalesce(_c(name), F.lit("")))
    fmt = (F.when(n.endswith(".pdf"), "pdf")
            .when(n.endswith(".tex") | n.endswith(".latex"), "tex")
            .when(n.endswith(".docx"), "docx")
            .when(n.endswith(".txt") | n.endswith(".md") | n.endswith(".markdown"), "txt"))
    size_err = (F.when(_c(size) > MAX_UPLOAD_BYTES, F.lit(TOO_LARGE_ERROR))
                 .when(_c(size) < 1, F.lit(EMPTY_ERROR)))
    type_err = (F.when(fmt.isNotNull(), F.lit(None).cast("string"))
                 .when(n.endswith(".doc"), F.lit(LEGACY_DOC_ERROR))
                 .otherwise(F.concat(F.lit("Unsupported file type: "), F.coalesce(_c(name), F.lit("")),
                                     F.lit(". Use .tex, .pdf, .docx, or .txt"))))
    return fmt, F.coalesce(size_err, type_err)
