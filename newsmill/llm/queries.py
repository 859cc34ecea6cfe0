"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from newsmill.llm.bpe import op7_bpe
from newsmill.llm.infill import OP13_SQL, op13_infill
from newsmill.llm.licences import op5_licences
from newsmill.llm.lines import OP4_SQL, op4_line_dedup
from newsmill.llm.packing import op2_packing
from newsmill.llm.pii import op8_pii
from newsmill.llm.quality import op10_quality_rules
from newsmill.llm.ranked import OP11_SQL, op11_ranked_search
from newsmill.llm.simhash import op1_simhash
from newsmill.llm.token_rollup import op6_token_counts
from newsmill.llm.topk import OP9_SQL, op9_top_products
from newsmill.llm.urlfilter import OP12_SQL, op12_url_filter
from newsmill.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_simhash": op1_simhash, "op2_packing": op2_packing, "op3_warc": op3_warc, "op4_line_dedup": op4_line_dedup,
    "op5_licences": op5_licences, "op6_token_counts": op6_token_counts, "op7_bpe": op7_bpe, "op8_pii": op8_pii,
    "op9_top_products": op9_top_products, "op10_quality_rules": op10_quality_rules,
    "op11_ranked_search": op11_ranked_search, "op12_url_filter": op12_url_filter, "op13_infill": op13_infill, "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op3_warc": OP3_SQL, "op4_line_dedup": OP4_SQL, "op9_top_products": OP9_SQL,
    "op11_ranked_search": OP11_SQL, "op12_url_filter": OP12_SQL, "op13_infill": OP13_SQL,
}
