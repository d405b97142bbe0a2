"""The queries of this package by name, and the SQL of those that SQL can express."""

from ledgerscope.llm.conversation_repair import OP12_SQL, op12_auction_repair
from ledgerscope.llm.cotrain import op3_cotraining_quality
from ledgerscope.llm.decontaminate import OP4_SQL, op4_size_partitioned_containment
from ledgerscope.llm.lang_id import op5_partial_matching
from ledgerscope.llm.near_dup import op7_signature_inverted_join
from ledgerscope.llm.packing import op2_sum_of_squares_packing
from ledgerscope.llm.pii import op8_offset_preserving_deobfuscation
from ledgerscope.llm.quality_rules import op6_distribution_divergence
from ledgerscope.llm.secret_scan import op9_randomness_battery
from ledgerscope.llm.suffix_dedup import OP11_SQL, op11_difference_cover_dedup
from ledgerscope.llm.token_alignment import op13_perfect_hash_alignment
from ledgerscope.llm.token_files import op10_simple8b_token_files
from ledgerscope.llm.warc import OP1_SQL, op1_merkle_fixity_audit

QUERIES = {
    f.__name__: f
    for f in (
        op1_merkle_fixity_audit,
        op2_sum_of_squares_packing,
        op3_cotraining_quality,
        op4_size_partitioned_containment,
        op5_partial_matching,
        op6_distribution_divergence,
        op7_signature_inverted_join,
        op8_offset_preserving_deobfuscation,
        op9_randomness_battery,
        op10_simple8b_token_files,
        op11_difference_cover_dedup,
        op12_auction_repair,
        op13_perfect_hash_alignment,
    )
}
SQL = {"op1_merkle_fixity_audit": OP1_SQL, "op4_size_partitioned_containment": OP4_SQL, "op11_difference_cover_dedup": OP11_SQL, "op12_auction_repair": OP12_SQL}
