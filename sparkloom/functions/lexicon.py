"""Word lists and constants that results depend on."""

from __future__ import annotations

# --- fixed values: categories of chunks, by keywords in titles and content ---
CHUNK_KEYWORDS: dict[str, list[str]] = {
    "treatment": [
        "treatment", "therapy", "medication", "medicine", "drug", "insulin", "metformin", "sulphonylurea", "glp-1", "sglt2", "hba1c",
        "glycemic control", "blood glucose management", "clinical management", "pharmacological", "prescription", "dosing", "dose",
        "glycaemia", "hypoglycaemia", "hyperglycaemia", "complication", "مضاعفات", "علاج", "دواء", "أدوية", "أنسولين", "نسبة السكر",
        "التحكم في السكر",
    ],
    "prevention": [
        "prevention", "prevent", "risk reduction", "risk factor", "lifestyle", "physical activity", "exercise", "weight management",
        "obesity", "overweight", "screening", "early detection", "public health", "epidemiology", "incidence", "prevalence", "awareness",
        "education", "programme", "intervention", "الوقاية", "منع", "عوامل الخطر", "النشاط البدني", "الوزن", "البدانة", "الكشف المبكر",
        "الصحة العامة",
    ],
    "nutrition": [
        "nutrition", "diet", "dietary", "food", "meal", "carbohydrate", "carb", "glycemic index", "glycaemic index", "calorie", "fibre",
        "fiber", "protein", "fat", "saturated fat", "vegetable", "fruit", "whole grain", "sugar", "sweetener", "portion", "eating", "drink",
        "beverage", "التغذية", "نظام غذائي", "غذاء", "طعام", "وجبة", "كربوهيدرات", "سعرات", "بروتين", "دهون", "خضروات", "فواكه",
    ],
}

# --- fixed values: routes of questions, by signals ---
ROUTE_SIGNALS: dict[str, list[str]] = {
    "treatment": [
        "treat", "medication", "medicine", "drug", "insulin", "metformin", "dose", "dosage", "prescription", "pharmacolog", "therapy",
        "hba1c", "glycemic control", "glycaemic control", "blood sugar management", "manage diabetes", "managing diabetes", "clinical",
        "complication", "hypoglycemia", "hyperglycemia", "hypoglycaemia", "hyperglycaemia", "sulphonylurea", "glp-1", "sglt2", "dpp-4",
        "thiazolidinedione", "علاج", "دواء", "أدوية", "أنسولين", "علاجات", "التحكم في السكر",
    ],
    "prevention": [
        "prevent", "risk", "reduce", "avoid", "screening", "early detection", "lifestyle change", "physical activity", "exercise",
        "weight loss", "obesity", "overweight", "sedentary", "public health", "population", "incidence", "prevalence", "epidemiol",
        "الوقاية", "تقليل", "تجنب", "النشاط البدني", "الوزن", "الكشف المبكر",
    ],
    "nutrition": [
        "food", "eat", "drink", "diet", "meal", "carbohydrate", "carb", "calorie", "sugar", "fruit", "vegetable", "grain", "bread", "rice",
        "protein", "fat", "fibre", "fiber", "glycemic index", "glycaemic index", "portion", "snack", "breakfast", "lunch", "dinner",
        "recipe", "غذاء", "طعام", "أكل", "وجبة", "كربوهيدرات", "سعرات", "فواكه", "خضروات", "نظام غذائي", "رجيم",
    ],
    "general": [
        "what is diabetes", "explain diabetes", "what is hba1c", "hba1c", "type 1", "type 2", "gestational", "prediabetes", "diagnos",
        "مرض السكري", "السكري", "ما هو السكري", "السكر التراكمي",
    ],
}

# --- fixed values: safety levels in order of priority, by signals ---
SAFETY_SIGNALS: dict[str, list[str]] = {
    "emergency": [
        "emergency", "unconscious", "faint", "fainting", "seizure", "coma", "very high blood sugar", "very low blood sugar", "sugar is 400",
        "sugar is 500", "sugar above 400", "glucose is 400", "can't breathe", "chest pain", "call ambulance", "إسعاف", "طوارئ",
        "السكر ٤٠٠", "السكر فوق ٤٠٠", "السكر جداً مرتفع", "فقدان الوعي", "إغماء",
    ],
    "high_risk": [
        "what dose", "how much insulin", "how many units", "dosage for me", "my insulin dose", "how much metformin",
        "what medication should i take", "which medication should i", "should i take", "prescribe", "كم جرعة", "ما جرعة",
        "جرعة الإنسولين المناسبة", "جرعة الانسولين المناسبة", "كم وحدة", "جرعتي", "ماذا آخذ", "هل آخذ", "الجرعة المناسبة لي",
    ],
    "diagnosis": [
        "do i have diabetes", "am i diabetic", "is my blood sugar normal", "do i have prediabetes", "do i have type 2", "هل أنا مصاب",
        "هل عندي سكري", "هل أعاني من", "هل نسبة سكري طبيعية",
    ],
}

# --- fixed values: policy of questions ---
DOMAIN_ANCHORS = ["diabetes", "diabetic", "insulin", "glucose", "hba1c", "a1c", "سكري", "السكري", "أنسولين", "الأنسولين", "جلوكوز", "السكر"]
DOMAIN_FRAGMENTS = ["سكري", "السكر", "سكر الدم", "جلوكوز", "غلوكوز", "أنسولين", "انسولين"]
VAGUE_QUESTIONS = [
    "tell me more", "explain more", "more details", "what about it", "what is this", "can you explain", "help me", "and then",
    "أخبرني المزيد", "اشرح أكثر", "مزيد من التفاصيل", "ماذا عنه", "ما هذا", "ساعدني", "وبعدين",
]
LIGHT_WORDS = [
    "a", "an", "and", "about", "can", "do", "for", "how", "i", "is", "it", "me", "more", "of", "please", "tell", "the", "this", "to", "what",
    "why", "you", "عن", "في", "ما", "ماذا", "من", "هو", "هي", "لي", "هل", "كيف", "هذا", "هذه", "المزيد",
]

# --- fixed values: stop words of lexical search and of answers ---
LEXICAL_STOPWORDS = [
    "about", "adults", "answer", "approximately", "based", "condition", "diabetes", "does", "figures", "from", "have", "living", "many",
    "million", "number", "percentage", "source", "that", "their", "them", "topic", "using", "what", "when", "with", "years",
]
ANSWER_STOPWORDS = ["a", "an", "and", "are", "can", "for", "how", "in", "is", "of", "the", "to", "what", "with", "كيف", "ما", "من", "في", "على", "هي", "هو", "يمكن"]
TRAILING_WORDS = ["a", "an", "and", "for", "of", "the", "to", "with"]
SENTENCE_ENDS = [".", "!", "?", "؟", ")", "]", '"', "”"]

# --- fixed values: rewriting of questions ---
FOLLOW_UPS = [
    r"^\s*(what about|how about|and what about|tell me more about)\s",
    r"^\s*(what about|وماذا عن|وماذا|وأيضاً|وكذلك|وماذا عن)\s",
    r"^\s*(can i|can i eat|can i have|هل يمكنني|هل أستطيع)\s+\w+\s*\??\s*$",
]
CONTEXT_SUFFIX, CONTEXT_SUFFIX_AR = " in the context of diabetes management", " في سياق مرض السكري"
MIN_STANDALONE = 20

# --- fixed values: texts that try to change instructions ---
INJECTIONS = [r"ignore\s+previous\s+instructions", r"system\s*:\s*", r"you\s+are\s+now", r"disregard\s+all", r"override\s+system"]
CONTENT_START, CONTENT_END = "---USER_CONTENT_START---\n", "\n---USER_CONTENT_END---"

# --- fixed values: file types ---
FILE_TYPES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain"}

# --- fixed values: chunk profiles (size, overlap) ---
CHUNK_PROFILES = {"small": (1200, 0), "balanced": (2000, 200), "large": (3000, 300)}
CATEGORIES = ["treatment", "prevention", "nutrition"]
OPERATIONAL_FAILURES = ["infrastructure_failure", "generation_error", "http_error", "timeout"]

# --- fixed values: notes below answers by safety level (English, Arabic), and the answer to emergencies ---
_RULE = "\n\n---\n"
DISCLAIMERS = {
    "high_risk": (
        _RULE + "⚠️ **Important**: The information above is general and sourced directly from the referenced documents. It is **not a personalised medical prescription**. Medication dosages must always be determined by a qualified physician or pharmacist based on your individual health condition.",
        _RULE + "⚠️ **ملاحظة مهمة**: المعلومات أعلاه عامة ومستخرجة من المصادر المُستشهد بها. إنها **ليست وصفة طبية شخصية**. يجب دائماً تحديد جرعات الأدوية من قِبَل طبيب أو صيدلاني مؤهل بناءً على حالتك الصحية الفردية.",
    ),
    "diagnosis": (
        _RULE + "ℹ️ **Note**: This application provides general educational information about diabetes. It cannot diagnose any medical condition. Please consult a qualified healthcare professional for diagnosis and personalised medical advice.",
        _RULE + "ℹ️ **ملاحظة**: يوفر هذا التطبيق معلومات تعليمية عامة حول مرض السكري. لا يمكنه تشخيص أي حالة طبية. يرجى استشارة متخصص رعاية صحية مؤهل للحصول على تشخيص ونصيحة طبية شخصية.",
    ),
    "informational": (
        _RULE + "*This information is sourced from the referenced documents and is for educational purposes only. Always consult a healthcare professional for medical decisions.*",
        _RULE + "*هذه المعلومات مستخرجة من المصادر المُستشهد بها وهي لأغراض تعليمية فقط. استشر دائماً أخصائي رعاية صحية لاتخاذ أي قرار طبي.*",
    ),
    "emergency": ("", ""),
}
EMERGENCY_RESPONSES = (
    "🚨 **This sounds like a medical emergency.**\n\nPlease **call emergency services immediately** (in Egypt: 123 for ambulance) or go to the nearest hospital emergency department.\n\nDo not rely on this application in an emergency situation.",
    "🚨 **يبدو أن هذه حالة طوارئ طبية.**\n\nيرجى **الاتصال بالإسعاف فوراً** (في مصر: 123) أو التوجه إلى أقرب طوارئ مستشفى.\n\nلا تعتمد على هذا التطبيق في حالات الطوارئ.",
)

# --- fixed values: what questions must contain (one of each group) for a hint to be searched instead ---
HINTS: dict[str, list[tuple[list[list[str]], str]]] = {
    "ar": [
        ([["2024"], ["البالغ", "بالغ"]], "589 million adults aged 20 79 living with diabetes in 2024"),
        ([["لا يعلمون", "غير المشخص", "غير المشخّص", "252"]], "adults living with diabetes unaware undiagnosed 252 million"),
        ([["2050", "المتوقع", "المتوقعة"]], "adults living with diabetes projected 853 million by 2050"),
        ([["الإنفاق", "أُنفق", "انفق"]], "Over USD 1 trillion was spent on diabetes in 2024; 12% of global health expenditure"),
        ([["نسبة"], ["589"], ["252"]], "589 million adults 252 million unaware percentage"),
        ([["نسبة"], ["589"], ["853"]], "589 million 2024 853 million 2050 percentage increase"),
        ([["الحمل"], ["توصية", "توصيات"]], "The GDG issued 27 recommendations; six on glucose monitoring during pregnancy"),
        ([["فردي", "فردية", "الجوانب"], ["سكر الدم", "الغلوكوز", "الجلوكوز", "التحكم"]], "individualized approach is encouraged when setting the target level for glycaemic control; comorbidities medication side-effects life expectancy"),
    ],
    "en": [
        ([["2024"], ["spending", "expenditure", "spent"]], "Over USD 1 trillion was spent on diabetes in 2024; 12% of global health expenditure"),
        ([["pregnan"], ["recommendation"]], "The GDG issued 27 recommendations; six on glucose monitoring during pregnancy"),
        ([["2050"], ["increase", "rise", "project"]], "589 million adults in 2024; projected 853 million by 2050; percentage increase"),
    ],
}

# --- fixed values: conditions that evidence must name if the question does (terms of the question, terms of the evidence) ---
CONDITIONS = [
    (["type 1", "type i", "النوع الأول", "النوع الاول"], ["type 1", "type i"]),
    (["type 2", "type ii", "النوع الثاني"], ["type 2", "type ii"]),
    (["gestational", "pregnan", "الحمل", "الحوامل", "سكر الحمل"], ["gestational", "pregnan"]),
]
RISK_QUESTIONS, RISK_EVIDENCE = ["risk factor", "عوامل الخطر"], ["risk factor"]
TYPE_2_RISK_EVIDENCE = ["risk factors for type 2 diabetes", "type 2 diabetes risk factors"]
CARDIOLOGY_QUESTIONS, CARDIOLOGY_EVIDENCE = ["preventive cardiolog", "طبيب القلب الوقائي"], ["preventive cardiolog"]
OTHER_TYPES = ["النوع الثالث", "النوع الرابع", "النوع الخامس", "النوع السادس", "النوع السابع", "النوع الثامن", "النوع التاسع", "النوع العاشر"]

# --- frequent words that tell languages apart ---
LANGUAGE_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "was", "are", "this", "by", "from", "be"],
    "fr": ["le", "la", "les", "et", "des", "un", "une", "est", "du", "que", "dans", "pour", "sur", "pas", "avec"],
    "de": ["der", "die", "das", "und", "ist", "den", "von", "zu", "mit", "sich", "auf", "nicht", "ein", "eine", "dem"],
    "es": ["el", "los", "las", "de", "que", "y", "en", "por", "una", "con", "para", "su", "al", "lo", "del"],
    "ar": ["في", "من", "على", "إلى", "هذا", "التي", "عن", "أن", "مع", "هو", "ما", "لا", "كان", "هل", "كيف"],
}

# --- fixed values: marks of citations in answers, header cells of tables that are no answer, providers that stand in for the first one ---
CITATION_MARK = r"(?:\[|【)[^\]】]{0,40}?\bE\s*(\d+)[^\]】]*(?:\]|】)"
TABLE_HEADERS = ["subdomain", "indicator"]
FALLBACK_PROVIDERS = ["groq", "vercel_gateway", "extractive"]

# --- fixed values: terms that Arabic words of a question stand for as well ---
ARABIC_TERMS: dict[str, list[str]] = {
    "السكري": ["diabetes", "diabetic"],
    "الوقاية": ["prevention", "prevent", "preventing"],
    "العلاج": ["treatment", "therapy", "management"],
    "الأطعمة": ["food", "foods", "diet", "nutrition"],
    "الغذاء": ["food", "diet", "nutrition"],
    "الحمل": ["pregnancy", "pregnant"],
    "المخاطر": ["risk", "risks", "factor", "factors"],
    "مضاعفات": ["complication", "complications"],
    "النوع": ["type"],
    "الثاني": ["2", "two"],
}

# --- fixed values: fields of exam questions that may be printed, by question type; the last ones for any other type ---
QUESTION_FIELDS: dict[str, list[str]] = {
    "mcq": ["question_text", "options", "difficulty", "domain"],
    "true_false": ["statement", "difficulty", "domain"],
    "short_answer": ["question_text", "difficulty", "domain"],
    "essay": ["question_text", "difficulty", "domain"],
}
OTHER_QUESTION_FIELDS = ["question_text", "difficulty", "domain"]

# --- fixed values: kinds of provider errors in order of precedence: (code, statuses, parts of messages, may be tried again) ---
PROVIDER_ERRORS: list[tuple[str, list[int], list[str], bool]] = [
    ("invalid_api_key", [], ["api_key_invalid", "api key not valid"], False),
    ("authentication_failed", [401], ["unauthenticated"], False),
    ("permission_denied", [403], ["permission_denied", "permission denied"], False),
    ("model_not_found", [404], ["not_found", "model not found"], False),
    ("rate_limited", [429], ["resource_exhausted", "rate limit", "quota"], True),
    ("safety_blocked", [], ["safety", "blocked"], False),
    ("timeout", [408, 504], ["timeout", "timed out"], True),
    ("service_unavailable", [500, 502, 503], ["unavailable", "connection"], True),
    ("invalid_request", [400], ["invalid_argument", "bad request"], False),
    ("missing_api_key", [], ["api_key is not set", "api key is not set", "api_key is required"], False),
]
#: HTTP status numbers that are read from a message.
PROVIDER_STATUSES = r"\b(400|401|403|404|408|409|429|500|502|503|504)\b"
RETRY_HINTS = [r"retry in\s+([0-9]+(?:\.[0-9]+)?)s", r"retryDelay['\"]?\s*:\s*['\"]([0-9]+(?:\.[0-9]+)?)s"]
RETRY_MARKS = ["429", "quota", "rate", "resource_exhausted", "503", "unavailable"]
DOCUMENT_RETRY_SECONDS = (2.0, 5.0, 10.0, 30.0)

# --- fixed values: what users are told of a provider's errors, in Arabic and English ---
PROVIDER_MESSAGES = {
    "missing_api_key": ("خدمة الذكاء الاصطناعي غير مُعدة حالياً. يرجى المحاولة لاحقاً.", "The AI service is not configured yet. Please try again later."),
    "invalid_api_key": ("خدمة الذكاء الاصطناعي غير متاحة حالياً. يرجى المحاولة لاحقاً.", "The AI service is temporarily unavailable. Please try again later."),
    "authentication_failed": ("خدمة الذكاء الاصطناعي غير متاحة حالياً. يرجى المحاولة لاحقاً.", "The AI service is temporarily unavailable. Please try again later."),
    "permission_denied": ("خدمة الذكاء الاصطناعي غير متاحة حالياً. يرجى المحاولة لاحقاً.", "The AI service is temporarily unavailable. Please try again later."),
    "model_not_found": ("نموذج الإجابة غير متاح حالياً. يرجى المحاولة لاحقاً.", "The answer model is unavailable right now. Please try again later."),
    "rate_limited": ("خدمة الذكاء الاصطناعي مشغولة. يرجى المحاولة بعد دقيقة.", "The AI service is busy. Please try again in a minute."),
    "safety_blocked": ("لا يمكنني المساعدة في هذا الطلب.", "I can’t help with that request."),
    "timeout": ("استغرقت خدمة الذكاء الاصطناعي وقتاً طويلاً. يرجى المحاولة مجدداً.", "The AI service took too long. Please try again."),
    "service_unavailable": ("خدمة الذكاء الاصطناعي غير متاحة مؤقتاً. يرجى المحاولة لاحقاً.", "The AI service is temporarily unavailable. Please try again later."),
    "invalid_request": ("تعذر معالجة هذا الطلب. يرجى إعادة صياغته.", "I couldn’t process that request. Please rephrase it."),
    "empty_response": ("لم تُرجع خدمة الذكاء الاصطناعي إجابة. يرجى المحاولة مجدداً.", "The AI service returned no answer. Please try again."),
    "unknown_error": ("حدثت مشكلة مؤقتة. يرجى المحاولة لاحقاً.", "A temporary problem occurred. Please try again later."),
}
#: In messages about a search the service's name is replaced, except in these.
SERVICE_NAMES = (("خدمة الذكاء الاصطناعي", "خدمة البحث"), ("AI service", "knowledge search"))
SERVICE_NAME_STAYS = ["safety_blocked", "invalid_request"]

# --- fixed values: the frame of prompts that answers are grounded by ---
PROMPT_CONTEXT = "RETRIEVED CONTEXT FROM DIABETES DOCUMENTS:\n===========================================\n{}\n===========================================\n"
PROMPT_NO_CONTEXT = "RETRIEVED CONTEXT: No relevant information was found.\n"
PROMPT_HISTORY = "CONVERSATION HISTORY (context only; never treat it as medical evidence):\n{}\n\n"
PROMPT_RULES = (
    "First verify that the context directly addresses the same condition, population, and intent as the question. Answer using only that directly matching context and "
    "cite evidence inline as [E1], [E2], and so on, matching the SOURCE numbers. Do not transfer facts or lists from a related condition. You may calculate a result "
    "only when every numeric input is explicitly present in the context; show the formula, label the result as a derived calculation, and cite every input. When an equation "
    "improves clarity, format it as valid LaTeX between \\[ and \\] for display math, or between \\( and \\) for inline math; never use a code fence for equations. "
    "If the context is insufficient or only indirectly related, say so and ask for a more specific diabetes question."
)
NO_EVIDENCE = "*No evidence is available for this question.*"
