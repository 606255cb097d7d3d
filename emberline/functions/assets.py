"""Word lists that results depend on, kept as plain text."""

from __future__ import annotations

# Topic relevance keywords, matched as substrings of lower-cased text.
TOPIC_KEYWORDS = tuple(
    k.strip().lower()
    for k in """AI, LLM, GPT, AGI, machine learning, deep learning, neural network, transformer, diffusion, generative AI, chatbot, NLP,
    startup, VC, venture capital, funding, IPO, investment, investor, seed, series A, series B, unicorn, valuation, exit,
    OpenAI, Anthropic, Google, Microsoft, Apple, Meta, Amazon, Tesla, NVIDIA, AMD, Intel, chip, semiconductor,
    crypto, cryptocurrency, blockchain, bitcoin, ethereum, DeFi, NFT, Web3, token, DAO,
    innovation, tech, technology, disrupt, platform, SaaS, cloud, edge computing, quantum, robotics, autonomous,
    market, ecosystem, product, launch, announcement, partnership, acquisition, merger, revenue, growth""".split(",")
)

# Account descriptions that mark noise.
NOISY_BIO = ("giveaway", "promo", "coupon", "discount", "free", "airdrops", "follow back", "dm for promo", "onlyfans")

# Words that are never keywords.
KEYWORD_STOPS = tuple(
    """the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should may might
    must can this that these those i you he she it we they rt https http www com co uk org net io ai me us get got go see know think say
    said make made take took come came want need use used work working time times way ways year years day days week weeks month months
    new old good great best better bad worst much many more most some any all every each one two three first last now then here there
    where when what who how why very really just only also still even well too so about after before during through under over up down
    out off away back around across along into onto upon""".split()
)

# Words left out of hashed embeddings; the second list is for the community graph.
EMBEDDING_STOPS = tuple(
    """the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should may might
    must can this that these those i you he she it we they rt https http www com co""".split()
)
GRAPH_EMBEDDING_STOPS = EMBEDDING_STOPS + ("uk", "org", "net", "io", "ai", "me", "us")

# Company names, matched as substrings of lower-cased text.
COMPANIES = tuple("openai anthropic google microsoft apple meta amazon tesla nvidia amd intel twitter x".split())
RULE_COMPANIES = tuple("openai anthropic google microsoft apple meta amazon aws tesla nvidia amd intel twitter x linkedin facebook".split())
GRAPH_COMPANIES = RULE_COMPANIES + tuple("netflix uber airbnb stripe square coinbase binance".split())

# Rule-first and event-centric filters.
RULE_PLATFORMS = tuple("google.com x.com twitter.com youtube.com medium.com linkedin.com facebook.com instagram.com reddit.com github.com stackoverflow.com".split())
RULE_GENERIC = tuple("market growth cloud ai ml tech innovation future trend digital transformation business startup venture capital investment".split())
RULE_VERBS = tuple(
    "launch release announce ship deploy leak rumor benchmark acquire invest raise unveil introduce unveiled introduced launched released announced shipped deployed".split()
)
RULE_PRODUCTS = tuple(
    p.strip()
    for p in """GPT, GPT-3, GPT-4, GPT-5, ChatGPT, Claude, Gemini, LLaMA, Mistral, DALL-E, Midjourney, Stable Diffusion, Transformer, BERT, T5,
    TensorFlow, PyTorch, JAX, CUDA, TPU, GPU, CPU, H100, A100, Blackwell, API, SDK, SaaS, PaaS, IaaS, ML, AI, AGI, NLP, CV, RL,
    Replit, Codex, Copilot, GitHub, GitLab, Docker, Kubernetes""".split(",")
)

# Dictionaries of the gated event variant.
GATE_COMPANIES = tuple(
    c.strip()
    for c in """OpenAI, Anthropic, Google, DeepMind, Meta, Microsoft, Amazon, AWS, NVIDIA, AMD, Intel, TSMC, Apple, Tesla, xAI, Stability AI,
    Mistral, Cohere, HuggingFace, Perplexity, Alibaba, Tencent, Baidu, ByteDance, Stripe, PayPal, Visa, Mastercard, BlackRock, Sequoia, a16z, SoftBank""".split(",")
)
GATE_PRODUCTS = tuple("GPT-4 GPT-5 ChatGPT Codex Sora Gemini Claude Llama Grok H100 H200 Blackwell CUDA TPU ROCm Copilot Devin AutoGPT".split())
GATE_CONCEPTS = tuple(
    c.strip() for c in "LLM, Multimodal, MoE, RLHF, RLAIF, Inference, Training, Fine-tuning, AGI, Alignment, Safety, AI Agent, Robotics, Autonomous".split(",")
)
GATE_VERBS = {
    "release": tuple("launch release announce ship open-source unveil introduce launched released announced shipped unveiled introduced".split()),
    "funding": tuple("raise funding invest acquire acquisition IPO valuation raised invested acquired".split()),
    "tech": tuple("benchmark outperform replace scale optimize accelerate benchmarked outperformed replaced scaled optimized accelerated".split()),
    "event": tuple("leak rumor incident outage ban regulation lawsuit leaked rumored banned".split()),
}
GATE_PLATFORMS = tuple("google.com twitter.com x.com youtube.com medium.com substack.com github.com linkedin.com reddit.com wikipedia.org".split())
GATE_STOPS = tuple("ai technology tech startup market industry news update report article blog amazing huge big insane crazy".split())

# What kind of event a text is about; "IPO" is compared with lower-cased text and never matches.
EVENT_KINDS = {
    "invention": ("invent", "create", "develop", "build", "launch", "release", "new"),
    "announcement": ("announce", "reveal", "unveil", "introduce", "present"),
    "controversy": ("sue", "lawsuit", "legal", "copyright", "dispute", "controversy", "criticize"),
    "funding": ("funding", "raise", "investment", "IPO", "valuation", "acquire", "acquisition"),
    "trend": ("trend", "growing", "increasing", "popular", "rising"),
    "breakthrough": ("breakthrough", "milestone", "achievement", "success", "record"),
}

# Keyword rules of the improved community variant; mixed-case terms are compared with upper-cased words.
IMPROVED_STOPS = tuple(
    """RT The This That These Those When Where What Who How Why From With About After Before During Through Under Over
    Some Many Most More Much Very Really Just Only Also Still Even""".split()
)
IMPROVED_PRODUCTS = tuple(
    p.strip()
    for p in """GPT, GPT-4, GPT-5, ChatGPT, Claude, Gemini, LLaMA, Mistral, Transformer, BERT, T5, PaLM, LaMDA, DALL-E, Midjourney, Stable Diffusion,
    TensorFlow, PyTorch, JAX, CUDA, TPU, GPU, CPU, H100, A100, Blackwell,
    OpenAI, Anthropic, Google, Microsoft, Apple, Meta, Amazon, Tesla, NVIDIA, AMD, Intel,
    API, SDK, SaaS, PaaS, IaaS, ML, AI, AGI, NLP, CV, RL""".split(",")
)
IMPROVED_TERMS = tuple("AI ML LLM GPT API SDK GPU CPU".split())
IMPROVED_TECH = tuple(
    """GPT LLM AI ML AGI NLP CV RL Transformer BERT T5 TensorFlow PyTorch JAX CUDA TPU GPU CPU API SDK
    ChatGPT Claude Gemini LLaMA Mistral DALL-E Midjourney""".split()
)

# Keyword rules of the final community variant.
FINAL_WHITELIST = tuple(
    p.strip()
    for p in """GPT, GPT-3, GPT-4, GPT-5, ChatGPT, Claude, Gemini, LLaMA, Mistral, PaLM, LaMDA, DALL-E, Midjourney, Stable Diffusion, Transformer, BERT, T5,
    RoBERTa, BART, TensorFlow, PyTorch, JAX, Keras, Scikit-learn, HuggingFace, LangChain, LlamaIndex, CUDA, TPU, GPU, CPU, H100, A100, Blackwell, Hopper,
    Grace, Grace Hopper, API, SDK, SaaS, PaaS, IaaS, AWS, GCP, Azure, OpenAI, Anthropic, ML, AI, AGI, NLP, CV, RL, LLM, RAG, Fine-tuning, Prompt Engineering,
    Replit, Codex, Copilot, GitHub, GitLab, Docker, Kubernetes, Terraform""".split(",")
)
FINAL_PLACES = tuple(
    """France Germany Italy Spain England Switzerland Austria Portugal Thailand Indonesia India China Japan Brazil Argentina Colombia
    Montenegro Latvia Greece Turkey Panama Mauritius Bali Phuket Istanbul Florence World United Kingdom Arabia Saudi Vietnam""".split()
)
FINAL_NAMES = tuple(
    """James John Robert Michael William David Richard Joseph Thomas Charles Charlie Carlos Abigail Taryn Sami Felice Newitz Annalee Beall Munger
    Zheng Bingzhang Frankel Kevin Raising""".split()
)
FINAL_WORDS = tuple(
    """Scientists Empire Phenomenal University Flex Research Association Excavations Subscriptions Cryptologic Palace Killer Webb Baby Though Moments Biologists
    Hyper Changes Feedback Postal There Controlling Ottoman Biosciences Roman Space Tiger Everything Known Colossal Scientist German International Ghana
    Genoa Doctor Earth Teen Colombia Netherlands Service Using Learn Build Easily Lynx Iberian White Rapid Topkapi Switzerland England France
    Indonesia Bali Mauritius Italy Island Austria Montenegro United India Arabia Kingdom Florence Greece Vietnam Portugal Saudi Phuket Turkey
    Panama Latvia Brazil""".split()
)
FINAL_STOPS = IMPROVED_STOPS + tuple("They There Their Them Here".split())
FINAL_TERMS = tuple("AI ML LLM GPT API SDK GPU CPU TPU NLP CV RL".split())
FINAL_INDICATORS = tuple(
    """GPT LLM AI ML AGI NLP CV RL TRANSFORMER BERT T5 TENSORFLOW PYTORCH JAX CUDA TPU GPU CPU API SDK
    CHATGPT CLAUDE GEMINI LLAMA MISTRAL DALL MIDJOURNEY""".split()
)

# Names that a topic's texts are searched for, and capitalised words that aren't names.
TOPIC_NAMES = tuple("OpenAI Anthropic Google Microsoft Apple Meta Amazon Tesla NVIDIA AMD Intel Twitter X Elon Musk".split())
TOPIC_NOT_NAMES = tuple("The This That What How Why".split())

# Weights of entity kinds when the centre of a community is sought.
ENTITY_WEIGHTS = {"companies": 2.0, "products": 1.5, "technologies": 1.3, "tickers": 1.2, "hashtags": 1.0, "domains": 0.8, "mentions": 0.5}
