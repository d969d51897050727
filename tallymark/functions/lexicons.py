"""Word lists, patterns and prompt texts of the scoring rules.

Results only agree with existing score tables when these agree letter for
letter.  Each is the default of a parameter, so other languages bring their own.
"""

# Ordered patterns for a numeric answer; the first match wins.
ANSWER_PATTERNS = (
    r"답(?:은|:)?\s*([+-]?\d+(?:[.,]\d+)?)",
    r"정답(?:은|:)?\s*([+-]?\d+(?:[.,]\d+)?)",
    r"결과(?:는|:)?\s*([+-]?\d+(?:[.,]\d+)?)",
    r"따라서\s*([+-]?\d+(?:[.,]\d+)?)",
    r"그러므로\s*([+-]?\d+(?:[.,]\d+)?)",
    r"= ([+-]?\d+(?:[.,]\d+)?)",
    r"([+-]?\d+(?:[.,]\d+)?)\s*(?:이다|입니다|다|개|명|원|kg|km|cm)",
    r"([+-]?\d+(?:[.,]\d+)?)$",
)

# Marks of a reasoning step.
STEP_INDICATORS = (
    r"(?:단계|과정)\s*\d+[:.]?\s*",
    r"(?:먼저|첫째|첫번째)[:.]?\s*",
    r"(?:다음|그다음|둘째|두번째)[:.]?\s*",
    r"(?:그러면|그러므로|따라서)[:.]?\s*",
    r"(?:마지막으로|결론적으로)[:.]?\s*",
)

# Connectives that make a reasoning step logical, and formula signs.
LOGICAL_WORDS = ("따라서", "그러므로", "그러면", "왜냐하면", "때문에", "결과적으로")
FORMULA_SIGNS = ("=", "+", "-", "×", "÷")

# Hedging words of numeric answers.
SURE_WORDS = ("확실", "분명", "명확", "틀림없이", "확실히", "반드시")
UNSURE_WORDS = ("아마", "추측", "생각", "불확실", "혹시", "가능성", "추정")

# Hedging expressions of prose answers.
SURE_EXPRESSIONS = ("확실히", "분명히", "틀림없이", "반드시", "정확히")
UNSURE_EXPRESSIONS = ("아마도", "추측하건대", "가능성이", "혹시", "생각해보면")

# Keyword shape, stop words, punctuation dropped before comparing.
KEYWORD = r"[가-힣]{2,}"
LONG_KEYWORD = r"[가-힣]{3,}"
STOPWORDS = ("것은", "것이", "그것", "이것", "저것", "무엇", "어떤", "하는", "되는", "있는", "없는")
PUNCTUATION = r"[.,!?;:()\"'『』「」\[\]]"

# Sentence endings, connectors and awkward shapes.
SENTENCE_ENDINGS = ("다", "요", "니다", "습니다", "죠", "네", "예")
CONNECTORS = ("그러나", "하지만", "그리고", "또한", "따라서", "그러므로", "즉", "예를 들어")
AWKWARD_PATTERNS = (r"(.)\1{3,}", r"[가-힣][a-zA-Z][가-힣]")

# System messages of the prompt templates.
LLAMA_SYSTEM = "주어진 질문에 정확하고 도움이 되는 답변을 제공하세요."
QWEN_SYSTEM = "당신은 도움이 되는 AI 어시스턴트입니다."

# Prompt templates by family: (without context, with context).
PROMPT_TEMPLATES = {
    "llama2": (
        "<s>[INST] {question} [/INST]",
        "<s>[INST] <<SYS>>\n" + LLAMA_SYSTEM + "\n<</SYS>>\n\n맥락: {context}\n\n질문: {question} [/INST]",
    ),
    "llama3": (
        "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n{question}<|eot_id|>"
        "<|start_header_id|>assistant<|end_header_id|>\n\n",
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n" + LLAMA_SYSTEM + "<|eot_id|>"
        "<|start_header_id|>user<|end_header_id|>\n\n맥락: {context}\n\n질문: {question}<|eot_id|>"
        "<|start_header_id|>assistant<|end_header_id|>\n\n",
    ),
    "mistral": (
        "<s>[INST] {question} [/INST]",
        "<s>[INST] 맥락: {context}\n\n질문: {question} [/INST]",
    ),
    "gemma": (
        "<start_of_turn>user\n{question}<end_of_turn>\n<start_of_turn>model\n",
        "<start_of_turn>user\n맥락: {context}\n\n질문: {question}<end_of_turn>\n<start_of_turn>model\n",
    ),
    "qwen": (
        "<|im_start|>system\n" + QWEN_SYSTEM + "<|im_end|>\n<|im_start|>user\n{question}<|im_end|>\n"
        "<|im_start|>assistant\n",
        "<|im_start|>system\n" + QWEN_SYSTEM + "<|im_end|>\n<|im_start|>user\n맥락: {context}\n\n"
        "질문: {question}<|im_end|>\n<|im_start|>assistant\n",
    ),
}
PROMPT_TEMPLATES["llama"] = PROMPT_TEMPLATES["llama2"]
PROMPT_TEMPLATES["llama3.1"] = PROMPT_TEMPLATES["llama3.2"] = PROMPT_TEMPLATES["llama3"]
PROMPT_TEMPLATES["qwen1.5"] = PROMPT_TEMPLATES["qwen2.5"] = PROMPT_TEMPLATES["qwen"]

# Known error messages in matching order: substring, category, severity, advice.
ERROR_PATTERNS = (
    ("cuda out of memory", "memory", "high", (
        "배치 크기를 줄여보세요",
        "4-bit 양자화를 활성화하세요 (load_in_4bit=True)",
        "더 작은 모델을 사용해보세요",
        "GPU 메모리를 정리하세요 (torch.cuda.empty_cache())",
    )),
    ("out of memory", "memory", "high", (
        "메모리 사용량을 확인하세요", "불필요한 프로세스를 종료하세요", "가상 메모리를 늘려보세요",
    )),
    ("memory_allocated", "memory", "medium", ("메모리 모니터링을 확인하세요",)),
    ("trust_remote_code", "model_loading", "medium", (
        "신뢰할 수 있는 모델인지 확인하세요", "trust_remote_code=True를 설정하세요 (보안 위험 주의)",
    )),
    ("model not found", "model_loading", "medium", (
        "모델 경로를 확인하세요", "Hugging Face Hub에서 모델이 존재하는지 확인하세요", "인터넷 연결을 확인하세요",
    )),
    ("repository not found", "model_loading", "medium", (
        "모델 저장소 이름을 확인하세요", "모델이 공개되어 있는지 확인하세요", "Hugging Face 토큰이 필요한지 확인하세요",
    )),
    ("403 forbidden", "permission", "medium", (
        "모델 접근 권한을 확인하세요", "Hugging Face 토큰을 설정하세요", "모델 라이선스를 확인하세요",
    )),
    ("already borrowed", "inference", "medium", (
        "스레드 안전성 문제입니다", "TOKENIZERS_PARALLELISM=false 환경변수를 설정하세요", "순차 처리로 변경하세요",
    )),
    ("signal only works in main thread", "inference", "low", (
        "메인 스레드가 아닌 곳에서 신호 처리를 시도했습니다", "멀티스레딩 환경에서는 신호 처리를 비활성화하세요",
    )),
    ("device-side assert triggered", "hardware", "high", (
        "CUDA 장치 오류입니다", "GPU 드라이버를 업데이트하세요", "CUDA 버전 호환성을 확인하세요",
    )),
    ("no module named", "dependency", "medium", (
        "필요한 패키지를 설치하세요", "pip install 명령어를 사용하세요", "가상환경이 활성화되어 있는지 확인하세요",
    )),
    ("import error", "dependency", "medium", ("패키지 설치를 확인하세요", "패키지 버전 호환성을 확인하세요")),
    ("configuration", "configuration", "medium", (
        "설정 파일 형식을 확인하세요", "필수 설정 항목이 누락되지 않았는지 확인하세요",
    )),
    ("invalid choice", "configuration", "medium", (
        "설정값이 허용된 범위 내에 있는지 확인하세요", "문서에서 유효한 옵션들을 확인하세요",
    )),
)

# Advice where no pattern matches, by exception type.
GENERIC_ADVICE = {
    "MemoryError": ("메모리 사용량을 줄여보세요", "불필요한 프로세스를 종료하세요", "배치 크기를 줄여보세요"),
    "ImportError": ("필요한 패키지를 설치하세요", "패키지 버전을 확인하세요"),
    "FileNotFoundError": ("파일 경로를 확인하세요", "파일이 존재하는지 확인하세요"),
    "PermissionError": ("파일/폴더 권한을 확인하세요", "관리자 권한으로 실행해보세요"),
}
DEFAULT_ADVICE = ("문서를 참조하거나 로그를 확인하세요",)

# Memory need in GB by size token of a model path, in matching order.
MODEL_SIZES_GB = (
    ("0.5b", 1.0), ("1b", 2.0), ("1.5b", 3.0), ("3b", 6.0), ("7b", 14.0), ("8b", 16.0), ("13b", 26.0),
    ("14b", 28.0), ("30b", 60.0), ("32b", 64.0), ("70b", 140.0), ("72b", 144.0),
)
SHORT_MODEL_SIZES_GB = (("7b", 14.0), ("13b", 26.0), ("30b", 60.0), ("70b", 140.0))
DEFAULT_MODEL_GB = 14.0
