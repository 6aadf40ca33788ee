"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from . import (balltree, chat, collocations, decontam, digestindex, filteraudit, langid, licenses, mixing, ngramjoin, repeats, sharding,
               warc)

QUERIES = {
    "op1_source_mix": mixing.op1,
    "op2_license_scan": licenses.op2,
    "op3_chat_trees": chat.op3,
    "op4_decontamination": decontam.op4,
    "op5_balanced_shards": sharding.op5,
    "op6_warc_bundles": warc.op6,
    "op7_repeat_removal": repeats.op7,
    "op8_language_id": langid.op8,
    "op9_ngram_join": ngramjoin.op9,
    "op10_exact_top_k": balltree.op10,
    "op11_collocations": collocations.op11,
    "op12_filter_audit": filteraudit.op12,
    "op13_digest_index": digestindex.op13,
}

SQL: dict[str, str] = {
    "op2_license_scan": licenses.OP2_SQL,
    "op3_chat_trees": chat.OP3_SQL,
    "op6_warc_bundles": warc.OP6_SQL,
    "op10_exact_top_k": balltree.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_filter_audit": filteraudit.OP12_SQL,
    "op13_digest_index": digestindex.OP13_SQL,
}
