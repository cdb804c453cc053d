import random

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel iris juniper katsura larch maple nutmeg oak pine quince rowan spruce tulip umbrella viburnum willow yew zelkova".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
