"""The registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from shelfcast.llm.bpe import op9_bpe_tree_concat
from shelfcast.llm.chat import ORACLE_SQL as CHAT_SQL
from shelfcast.llm.chat import op12_chat_format
from shelfcast.llm.language import op6_language_id
from shelfcast.llm.licences import op1_license_scan
from shelfcast.llm.manifest import ORACLE_SQL as MANIFEST_SQL
from shelfcast.llm.manifest import op11_merkle_manifest
from shelfcast.llm.merkle import op7_merkle_fingerprint
from shelfcast.llm.mixing import op5_mix_sources
from shelfcast.llm.pages import op2_site_style_tree
from shelfcast.llm.quality import ORACLE_SQL as QUALITY_SQL
from shelfcast.llm.quality import op10_quality_cascade
from shelfcast.llm.ranked import ORACLE_SQL as RANKED_SQL
from shelfcast.llm.ranked import op13_ranked_search
from shelfcast.llm.simhash import op8_simhash_near_dedup
from shelfcast.llm.substrings import ORACLE_SQL as SUBSTRINGS_SQL
from shelfcast.llm.substrings import op3_substring_dedup
from shelfcast.llm.toxicity import op4_toxicity_gbt

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_site_style_tree": op2_site_style_tree,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity_gbt": op4_toxicity_gbt,
    "op5_mix_sources": op5_mix_sources,
    "op6_language_id": op6_language_id,
    "op7_merkle_fingerprint": op7_merkle_fingerprint,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_bpe_tree_concat": op9_bpe_tree_concat,
    "op10_quality_cascade": op10_quality_cascade,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_chat_format": op12_chat_format,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE: dict[str, str] = {
    "op3_substring_dedup": SUBSTRINGS_SQL,
    "op10_quality_cascade": QUALITY_SQL,
    "op11_merkle_manifest": MANIFEST_SQL,
    "op12_chat_format": CHAT_SQL,
    "op13_ranked_search": RANKED_SQL,
}
