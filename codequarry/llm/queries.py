"""Registry of the corpus operators' queries; SQL is given where SQL can express the operator."""

from codequarry.llm.decontaminate import ORACLE as DECONTAMINATE_SQL
from codequarry.llm.decontaminate import op10_decontaminate
from codequarry.llm.jaccard import ORACLE as JACCARD_SQL
from codequarry.llm.jaccard import op5_jaccard
from codequarry.llm.langid import op1_language_id
from codequarry.llm.licenses import op12_licenses
from codequarry.llm.mixture import op4_mixture
from codequarry.llm.pii import op6_pii
from codequarry.llm.quality import op3_quality
from codequarry.llm.repeats import op8_repeats
from codequarry.llm.secrets import op2_secrets
from codequarry.llm.toxicity import op7_toxicity
from codequarry.llm.trie import ORACLE as TRIE_SQL
from codequarry.llm.trie import op13_prefix_trie
from codequarry.llm.warc import ORACLE as WARC_SQL
from codequarry.llm.warc import op9_warc
from codequarry.llm.whitening import op11_whitening

_ALL = (
    op1_language_id, op2_secrets, op3_quality, op4_mixture, op5_jaccard, op6_pii, op7_toxicity, op8_repeats, op9_warc, op10_decontaminate,
    op11_whitening, op12_licenses, op13_prefix_trie,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op5_jaccard": JACCARD_SQL, "op9_warc": WARC_SQL, "op10_decontaminate": DECONTAMINATE_SQL, "op13_prefix_trie": TRIE_SQL}
