"""Page text: markup out, entities decoded; only the entities themselves pass through Python."""

from __future__ import annotations

import html as markup

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Elements dropped together with their content; the first two hold no markup, so
# that one that is never closed goes on to the end of the page.
DROPPED_ELEMENTS = ("script", "style", "nav", "footer", "header")
RAW_ELEMENTS = ("script", "style")
ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"


@F.arrow_udf(ArrayType(StringType()))
def _decoded(entities: pa.Array) -> pa.Array:
    """Each entity's characters, by the standard's table; what is no entity stays. A fixed blank is a blank."""
    flat = entities.flatten()
    once = flat.dictionary_encode()
    table = [markup.unescape(e).replace("\xa0", " ") for e in once.dictionary.to_pylist()]
    found = pa.array(table, pa.string()).take(once.indices)
    sizes = pc.fill_null(pc.list_value_length(entities), 0)
    offsets = pa.array([0, *pc.cumulative_sum(sizes).to_pylist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, found)


def decode_entities(text: Column) -> Column:
    """Named and numeric entities as their characters, each once: ``&amp;lt;`` is ``&lt;``."""
    pieces = F.split(text, ENTITY)
    found = _decoded(F.coalesce(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.array().cast("array<string>")))
    both = F.zip_with(pieces, found, lambda piece, entity: F.concat(piece, F.coalesce(entity, F.lit(""))))
    return F.array_join(both, "")


def page_text(html: Column) -> Column:
    """Text nodes separated by spaces; call ``clean_text`` on the result for the case text."""
    out = F.regexp_replace(html, rf"(?is)<({'|'.join(DROPPED_ELEMENTS)})\b[^>]*>.*?</\1\s*>", "")
    out = F.regexp_replace(out, rf"(?is)<(?:{'|'.join(RAW_ELEMENTS)})\b[^>]*>.*", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"<[/!?a-zA-Z][^>]*>", " ")
    return decode_entities(out)
