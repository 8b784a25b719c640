"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import language, line_dedup, near_copies, packing, repeated_spans, topk, toxicity, warc
from .media import op2_media_columns
from .mixture import op9_mixture

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_media_columns": op2_media_columns,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_repeated_spans": repeated_spans.op4_repeated_spans,
    "op5_packing": packing.op5_packing,
    "op6_warc": warc.op6_warc,
    "op7_language": language.op7_language,
    "op8_top_k": topk.op8_top_k,
    "op9_mixture": op9_mixture,
    "op10_near_copies": near_copies.op10_near_copies,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_repeated_spans": repeated_spans.ORACLE,
    "op6_warc": warc.ORACLE,
    "op8_top_k": topk.ORACLE,
    "op10_near_copies": near_copies.ORACLE,
}
