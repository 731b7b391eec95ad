"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from seamline.llm.codebooks import op13_vector_codes
from seamline.llm.dialogue import op11_conversation_repair
from seamline.llm.jaccard import op10_jaccard_join
from seamline.llm.licenses import SQL as LICENSE_SQL
from seamline.llm.licenses import op8_license_scan
from seamline.llm.media import op6_iso_media
from seamline.llm.mixing import op2_entropy_mix
from seamline.llm.oracles import codes_sql, repair_sql
from seamline.llm.pieces import op3_piece_nbest
from seamline.llm.pii import op9_pii
from seamline.llm.quality import op4_quality_rules
from seamline.llm.quotes import op7_quote_links
from seamline.llm.secrets import op5_secret_scan
from seamline.llm.sharding import op1_minimax_shards
from seamline.llm.tokens import op12_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_minimax_shards,
        op2_entropy_mix,
        op3_piece_nbest,
        op4_quality_rules,
        op5_secret_scan,
        op6_iso_media,
        op7_quote_links,
        op8_license_scan,
        op9_pii,
        op10_jaccard_join,
        op11_conversation_repair,
        op12_token_counts,
        op13_vector_codes,
    )
}
ORACLE_SQL: dict[str, str] = {"op8_license_scan": LICENSE_SQL, "op11_conversation_repair": repair_sql(), "op13_vector_codes": codes_sql()}
