from claimspark.functions.text import (  # noqa: F401
    capitalized_word_ratio,
    clean_categorical,
    clean_text,
    count_char,
    first_sentences,
    ngrams,
    tokens,
    whitespace_words,
    word_count,
)
from claimspark.functions.numeric import coerce_count, parse_count, safe_ratio, softmax2  # noqa: F401
