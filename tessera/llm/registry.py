"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm.bpe import op10_bpe
from tessera.llm.jaccard import op2_jaccard
from tessera.llm.language import op8_language
from tessera.llm.licences import op4_licenses
from tessera.llm.linededup import op9_lines
from tessera.llm.lm import op7_lm
from tessera.llm.media import op1_media
from tessera.llm.packing import op3_packing
from tessera.llm.topk import OP6_SQL, op6_topk
from tessera.llm.urlfilter import OP5_SQL, op5_urls

QUERIES = {
    "op1_media": op1_media,
    "op2_jaccard": op2_jaccard,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_urls": op5_urls,
    "op6_topk": op6_topk,
    "op7_lm": op7_lm,
    "op8_language": op8_language,
    "op9_lines": op9_lines,
    "op10_bpe": op10_bpe,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op5_urls": OP5_SQL,
    "op6_topk": OP6_SQL,
}
