"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from graincast.llm.alignment import op12_bitset_alignment
from graincast.llm.bpe import op9_bpe_tree
from graincast.llm.extraction import op2_wrapper_extract
from graincast.llm.fingerprints import op7_oph_fingerprints
from graincast.llm.langid import op8_hd_langid
from graincast.llm.mixing import OP5_SQL, op5_mix_sources
from graincast.llm.neardup import op4_minhash_inverted_join
from graincast.llm.pii import op6_surrogates
from graincast.llm.quality import op3_divergence_quality
from graincast.llm.runs import op11_word_runs
from graincast.llm.sharding import OP1_SQL, op1_rendezvous_shards
from graincast.llm.site_lines import OP10_SQL, op10_site_lines
from graincast.llm.toxicity import op13_gru_toxicity

QUERIES = {
    "op1_rendezvous_shards": op1_rendezvous_shards,
    "op5_mix_sources": op5_mix_sources,
    "op6_surrogates": op6_surrogates,
    "op7_oph_fingerprints": op7_oph_fingerprints,
    "op2_wrapper_extract": op2_wrapper_extract,
    "op3_divergence_quality": op3_divergence_quality,
    "op4_minhash_inverted_join": op4_minhash_inverted_join,
    "op8_hd_langid": op8_hd_langid,
    "op9_bpe_tree": op9_bpe_tree,
    "op10_site_lines": op10_site_lines,
    "op11_word_runs": op11_word_runs,
    "op12_bitset_alignment": op12_bitset_alignment,
    "op13_gru_toxicity": op13_gru_toxicity,
}

SQL = {
    "op1_rendezvous_shards": OP1_SQL,
    "op5_mix_sources": OP5_SQL,
    "op10_site_lines": OP10_SQL,
}
