"""Fixed values that results depend on: word lists, weights and patterns, stated plainly and kept together."""

# Words that mark the kind of a query.
FACTUAL = ["what is", "who is", "when did", "where is", "define"]
ANALYTICAL = ["how does", "why does", "explain", "analyze", "impact"]
COMPARATIVE = ["compare", "difference", "better", "worse", "versus", "vs"]
NAVIGATIONAL = ["find", "locate", "show me", "where can i", "documentation"]
MULTI_HOP = ["and", "then", "affect", "cause", "lead to", "result in"]

# Words that decide between vector and graph retrieval.
CONCEPTUAL = [
    "relationship", "compare", "difference", "versus", "vs", "better than", "trade-off", "when to use", "architecture", "overview", "explain", "concept", "how does", "why", "related", "connection", "between",
]
SPECIFIC = ["code", "implement", "example", "snippet", "function", "class", "api", "syntax", "error", "specific", "exact", "precise", "step", "command", "parameter", "configuration", "setting"]

# Words without meaning of their own in a query.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "what", "when", "where", "who", "why", "how", "which", "does", "do",
]

# Synonyms of technical terms.
SYNONYMS = {
    "auth": ["authentication", "authorization", "login", "signin"],
    "api": ["interface", "endpoint", "service", "REST API"],
    "db": ["database", "datastore", "storage", "repository"],
    "config": ["configuration", "settings", "parameters", "options"],
    "error": ["exception", "failure", "issue", "problem", "bug"],
    "user": ["client", "customer", "account", "member"],
    "create": ["add", "insert", "generate", "make", "build"],
    "delete": ["remove", "drop", "destroy", "purge", "clear"],
    "update": ["modify", "change", "edit", "alter", "patch"],
    "get": ["fetch", "retrieve", "read", "find", "query"],
    "performance": ["speed", "efficiency", "optimization", "latency"],
    "security": ["protection", "safety", "vulnerability", "threat"],
    "deploy": ["release", "publish", "ship", "rollout", "launch"],
    "test": ["validate", "verify", "check", "QA", "testing"],
    "log": ["logging", "audit", "trace", "record", "track"],
}

# What a query's entities are looked for by.
TECH_KEYWORDS = ["cache", "memory", "database", "api", "model", "algorithm", "neural", "network", "machine learning", "deep learning", "vector", "embedding", "search", "retrieval", "graph"]

# Acronyms and what they stand for.
ACRONYMS = {
    "rag": "retrieval augmented generation",
    "llm": "large language model",
    "nlp": "natural language processing",
    "api": "application programming interface",
    "aws": "amazon web services",
    "gcp": "google cloud platform",
    "ml": "machine learning",
    "ai": "artificial intelligence",
    "bert": "bidirectional encoder representations from transformers",
    "gpt": "generative pre-trained transformer",
}

# Document classes by words of the path, then of the text.
PATH_TYPES = {
    "values": ["values", "charter", "legal", "contract", "policy"],
    "project": ["spec", "architecture", "design", "workflow", "technical"],
    "meeting": ["meeting", "notes", "minutes", "standup"],
}
TEXT_TYPES = {
    "project": ["milestone", "sprint", "deadline", "specification"],
    "meeting": ["meeting", "action items", "attendees"],
}

# Weibull decay (shape, scale in days, least value) by document class.
DECAY = {"project": (2.5, 120.0, 0.1), "meeting": (0.8, 14.0, 0.05), "default": (1.5, 60.0, 0.1)}
TIMELESS = ["values", "legal", "charter", "policy"]

# Words that make a query ask for new or for old documents.
RECENT = ["latest", "current", "recent", "new"]
HISTORICAL = ["historical", "archive", "old", "previous"]

# Technical entities in texts.
TECHNICAL = [
    (r"\b(GPT-[234]|BERT|RoBERTa|T5|CLIP|DALL-E|Claude|LLaMA|Mistral)\b", "model"),
    (r"\b(transformer|attention|encoder|decoder|embedding)\s+model\b", "model"),
    (r"\b(PyTorch|TensorFlow|Keras|scikit-learn|pandas|numpy|FastAPI|Django)\b", "library"),
    (r"\b(LangChain|LlamaIndex|Haystack|Semantic Kernel)\b", "framework"),
    (r"\b(PostgreSQL|MySQL|MongoDB|Redis|Neo4j|Qdrant|Pinecone|Weaviate)\b", "database"),
    (r"\b(vector\s+(database|db|store))\b", "database"),
    (r"\b(AWS|Azure|GCP|Google Cloud)\b", "cloud_service"),
    (r"\b(S3|EC2|Lambda|SageMaker|Bedrock)\b", "cloud_service"),
    (r"\b(HNSW|IVF|LSH|k-means|PageRank|BFS|DFS)\b", "algorithm"),
    (r"\b(RAG|retrieval[- ]augmented|GraphRAG|HybridRAG)\b", "rag_pattern"),
    (r"\b(chunking|embedding|reranking|retrieval)\b", "rag_component"),
    (r"\b(few-shot|zero-shot|chain-of-thought|CoT|ReAct)\b", "prompting"),
]

# How a relation between two entities is worded.
RELATIONS = {
    "USES": ["uses", "utilizes", "employs", "leverages"],
    "IMPLEMENTS": ["implements", "realizes", "executes"],
    "CONTAINS": ["contains", "includes", "comprises", "has"],
    "DEPENDS_ON": ["depends on", "requires", "needs"],
    "PRODUCES": ["produces", "generates", "creates", "outputs"],
    "IMPROVES": ["improves", "enhances", "optimizes"],
    "COMPARES_TO": ["versus", "vs", "compared to", "better than"],
    "PART_OF": ["part of", "component of", "belongs to"],
    "INTEGRATES": ["integrates", "connects", "interfaces"],
}

# Words by which a query sets the weight of vector results; the first group that has one decides, else 0.7.
ADAPTIVE = [
    (["how many", "count", "list all", "who are", "what entities"], 0.3),
    (["explain", "why", "how does", "describe", "what is"], 0.8),
    (["relationship", "connection", "related", "similar"], 0.4),
]

# Words that call for several hops.
HOP_WORDS = ["affect", "cause", "lead to", "result in", "impact", "influence"]

# Words that refer to an earlier part of a query.
BACK_REFERENCES = ["it", "this", "that", "these", "those"]

# Weight of vector results recommended for a kind of query; others 0.5.
RECOMMENDED = {
    "factual": (0.3, "Graph search excels at finding specific facts and entities"),
    "conceptual": (0.7, "Vector search better understands abstract concepts"),
    "navigational": (0.2, "Graph search directly finds named entities"),
    "analytical": (0.5, "Balanced approach for analytical queries"),
    "exploratory": (0.6, "Vector search helps discover related content"),
}
RECOMMENDED_ELSE = (0.5, "Balanced fusion for general queries")

# Phrases after which a text tells its date, and when it ends.
CREATED = [r"(?:created|written|prepared|dated?)[:\s]+([^\n]+)", r"(?:date|updated)[:\s]+([^\n]+)", r"(?:as of|effective)[:\s]+([^\n]+)"]
EXPIRES = [r"(?:expires?|valid until|effective until)[:\s]+([^\n]+)", r"(?:deadline|due date|milestone date)[:\s]+([^\n]+)", r"(?:end date|completion date)[:\s]+([^\n]+)"]

# What a request gets that reasoning over the graph can't answer.
NO_STARTS = "I couldn't find relevant information to start answering this question."
NO_PATHS = "I found relevant starting points but couldn't connect them to answer your question."

# How sound chunks begin and end, and words with which a chunk may go on.
GOOD_START = r"""^[A-Z#0-9\[\-*>`"'({]|^(def |class |import |from |async |await |function |const |let |var )"""
GOOD_END = r"""[.!?:;}\])"'`]$|[\p{L}\p{N}_]$"""
CONTINUED = ["which", "that", "where", "when", "who"]
