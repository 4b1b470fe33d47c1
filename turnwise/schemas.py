"""Explicit schemas of the tables an analysis reads, so that no source is scanned for inference."""

CONVERSATIONS = (
    "user_id STRING, conversation_id STRING, "
    "conversation_history ARRAY<STRUCT<role: STRING, content: STRING, if_chosen: BOOLEAN>>"
)
SURVEY = (
    "user_id STRING, age STRING, gender STRING, employment_status STRING, education STRING, "
    "marital_status STRING, english_proficiency STRING, lm_familiarity STRING, "
    "religion STRUCT<simplified: STRING>, ethnicity STRUCT<simplified: STRING>, "
    "location STRUCT<birth_region: STRING, reside_region: STRING>"
)
UTTERANCES = (
    "conversation_id STRING, user_id STRING, turn INT, if_chosen BOOLEAN, user_prompt STRING, "
    "model_response STRING, utterance_order BIGINT"
)
QUESTIONS = (
    "q_id STRING, question STRING, correct_answer STRING, baseline_answer STRING, domain STRING"
)
ANSWER_KEY = "domain STRING, label STRING, question_text STRING"
ANSWERS = (
    "model STRING, dataset STRING, condition STRING, conversation_id STRING, q_id STRING, "
    "answer STRING"
)
TOPIC_OF_CONVERSATION = "id STRING, cluster_id INT"
TOPIC_NAMES = "cluster_id INT, gpt_description STRING"
LEXICON = "word STRING, category STRING, weight DOUBLE"
REPRESENTATIONS = "conversation_id STRING, layer INT, features ARRAY<FLOAT>"
REQUESTS = (
    "custom_id STRING, body STRUCT<model: STRING, "
    "messages: ARRAY<STRUCT<role: STRING, content: STRING>>, reasoning: STRUCT<enabled: BOOLEAN>>"
)
RESPONSES = (
    "custom_id STRING, response STRUCT<body: STRUCT<choices: "
    "ARRAY<STRUCT<message: STRUCT<content: STRING>>>>>"
)
