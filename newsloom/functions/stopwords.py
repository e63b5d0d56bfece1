"""Words the title vectoriser ignores (English and Portuguese)."""

ENGLISH = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "shall", "can", "need", "dare", "ought", "used", "to", "of",
    "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above",
    "below", "between", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no",
    "not", "only", "own", "same", "so", "than", "too", "very", "just", "because", "but", "and", "or", "if", "while",
    "about", "up", "its", "it", "he", "she", "they", "we", "you", "i", "this", "that", "these", "those", "what",
    "which", "who", "whom", "his", "her", "their", "our", "my", "your", "new", "says", "said",
]

PORTUGUESE = [
    "a", "o", "e", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas", "um", "uma", "uns", "umas", "por",
    "para", "com", "sem", "sob", "sobre", "entre", "que", "se", "ao", "aos", "pelo", "pela", "pelos", "pelas", "como",
    "mais", "menos", "muito", "muita", "muitos", "muitas", "outro", "outra", "outros", "outras", "esse", "essa",
    "esses", "essas", "este", "esta", "estes", "estas", "aquele", "aquela", "isso", "isto", "ele", "ela", "eles",
    "elas", "seu", "sua", "seus", "suas", "nos", "lhe", "lhes", "me", "te", "vos", "foi", "ser", "ter", "estar",
    "tem", "pode", "vai", "diz", "disse", "ja", "ainda", "tambem", "ou", "mas", "nem", "nao", "sim", "ha", "sao",
]

TITLE_STOPWORDS = sorted(set(ENGLISH) | set(PORTUGUESE))
