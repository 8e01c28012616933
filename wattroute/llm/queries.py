"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from wattroute.llm import decontaminate, licenses, repair, topk, trie, warc
from wattroute.llm.bpe import op10_bpe
from wattroute.llm.decontaminate import op5_decontaminate
from wattroute.llm.langid import op1_langid
from wattroute.llm.licenses import op8_licenses
from wattroute.llm.lm import op4_lm
from wattroute.llm.quality import op6_quality
from wattroute.llm.repair import op11_repair
from wattroute.llm.secrets import op3_secrets
from wattroute.llm.simhash import op2_simhash
from wattroute.llm.tokenfile import op7_tokenfile
from wattroute.llm.topk import op9_topk
from wattroute.llm.trie import op13_trie
from wattroute.llm.warc import op12_warc


def queries():
    found = [op1_langid, op2_simhash, op3_secrets, op4_lm, op5_decontaminate, op6_quality, op7_tokenfile, op8_licenses, op9_topk, op10_bpe, op11_repair, op12_warc, op13_trie]
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op5_decontaminate": decontaminate.SQL, "op8_licenses": licenses.SQL, "op9_topk": topk.SQL, "op11_repair": repair.SQL, "op12_warc": warc.SQL, "op13_trie": trie.SQL}
