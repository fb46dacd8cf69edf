"""The operators' queries by name, and the DuckDB text of those that SQL can express."""

from murmura.llm.bpe_automaton import op8_bpe_automaton
from murmura.llm.chat_format import OP5_SQL, op5_chat_formatting
from murmura.llm.embedding_dedup import op3_embedding_dedup
from murmura.llm.language_model import op9_language_model
from murmura.llm.ngram_jaccard import op4_ngram_jaccard_join
from murmura.llm.packing import op10_packing
from murmura.llm.periodic_runs import op13_periodic_runs
from murmura.llm.quality_classifier import op7_quality_classifier
from murmura.llm.quality_rules import OP1_SQL, op1_quality_rules
from murmura.llm.ranked_search import OP11_SQL, op11_ranked_search
from murmura.llm.suffix_dedup import op12_suffix_dedup
from murmura.llm.token_counts import op2_token_counts
from murmura.llm.token_output import op6_token_output

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_token_output": op6_token_output,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_bpe_automaton": op8_bpe_automaton,
    "op9_language_model": op9_language_model,
    "op10_packing": op10_packing,
    "op11_ranked_search": op11_ranked_search,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op5_chat_formatting": OP5_SQL, "op11_ranked_search": OP11_SQL}
