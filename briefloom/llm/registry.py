"""The queries of this subpackage and the SQL that states the expressible ones."""

from __future__ import annotations

from briefloom.llm import embeddings, oracles
from briefloom.llm.chat_format import op12_chat_formatting
from briefloom.llm.decontaminate import op6_decontaminate
from briefloom.llm.embeddings import op1_embedding_near_dedup
from briefloom.llm.html_text import op2_html_extraction
from briefloom.llm.langid import op3_language_id
from briefloom.llm.licenses import op7_license_scan
from briefloom.llm.ngram_join import op4_ngram_jaccard_join
from briefloom.llm.packing import op9_packing
from briefloom.llm.prefix_trie import op11_conversation_prefix_trie
from briefloom.llm.resampling import op13_importance_resampling
from briefloom.llm.secrets import op10_secret_scan
from briefloom.llm.token_counts import op8_token_counts
from briefloom.llm.toxicity import op5_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_html_extraction,
        op3_language_id,
        op4_ngram_jaccard_join,
        op5_toxicity,
        op6_decontaminate,
        op7_license_scan,
        op8_token_counts,
        op9_packing,
        op10_secret_scan,
        op11_conversation_prefix_trie,
        op12_chat_formatting,
        op13_importance_resampling,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": embeddings.ORACLE,
    "op4_ngram_jaccard_join": oracles.NGRAM_JACCARD_JOIN,
    "op10_secret_scan": oracles.SECRET_SCAN,
    "op11_conversation_prefix_trie": oracles.PREFIX_TRIE,
    "op12_chat_formatting": oracles.CHAT_FORMATTING,
}
