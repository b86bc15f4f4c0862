"""Fixed values.

Everything in this module must equal the behaviour being reproduced
(limits, prompt texts, request parameters, voice names, audio constants,
export tags).  They are stated plainly and in their natural order; change
them only if the behaviour to match changes.
"""

# ---------------------------------------------------------------- fixed values
# Text preparation
MAX_CHARS = 100_000          # cumulative character cap per document
CHUNK_WORDS = 1_000          # words per chunk
PAGE_SEPARATOR = "\n"        # appended after every page
CHUNK_SEPARATOR = "\n\n"     # appended after every cleaned chunk
CLEAN_FILE_PREFIX = "clean_"
CLEAN_FILE_SUFFIX = ".txt"
PDF_SUFFIX = ".pdf"

# Characters that Python's str.split() / str.strip() treat as whitespace.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Chat requests: cleaning, transcript, rewrite
CLEAN_SYSTEM_PROMPT = """You are a helpful assistant that cleans up text extracted from PDFs. Your task is to:
    1. Remove LaTeX math notation
    2. Fix formatting issues and remove unnecessary whitespace
    3. Remove references, citations, and footnotes
    4. Make the text more suitable for podcast transcription
    5. Preserve the main content and meaning
    Only output the cleaned text without any explanations or additional commentary."""
CLEAN_USER_PREFIX = "Clean this text: "
CLEAN_TEMPERATURE = 0.3
CLEAN_MAX_TOKENS = 2000

TRANSCRIPT_SYSTEM_PROMPT = """You are a world-class podcast writer. Your task is to convert educational text into natural-sounding podcast dialogue between two speakers:

Speaker 1 is the lead teacher who explains concepts and shares anecdotes.
Speaker 2 is a curious learner who asks insightful follow-up questions.

Make the dialogue sound natural by:
- Including filler words (um, hmm)
- Adding brief interruptions
- Using conversational language
- Including natural back-and-forth
- Adding relevant examples and analogies

Format the output as:
Speaker 1: [dialogue]
Speaker 2: [dialogue]

Keep the technical accuracy but make it engaging and conversational."""
TRANSCRIPT_USER_PREFIX = "Convert this text into a natural podcast dialogue: "
TRANSCRIPT_TEMPERATURE = 1.0
TRANSCRIPT_MAX_TOKENS = 4000
TRANSCRIPT_STREAM = False

REWRITE_SYSTEM_PROMPT = """You are an Oscar-winning screenwriter tasked with rewriting podcast transcripts into more natural, dramatic conversations.

SPEAKER ROLES:
- Speaker 1: The lead conversationalist who teaches and shares anecdotes
  * MUST NOT use any expressions like "umm", "hmm", "[laughs]", "[sigh]"
  * Should be clear, confident, and professional
  * Can use phrases like "Let me explain", "The key point is", "To put it simply"

- Speaker 2: The curious listener who asks follow-up questions
  * CAN use expressions like "hmm", "umm", "[laughs]", "[sigh]"
  * Should ask insightful questions
  * Can show enthusiasm and emotional reactions

FORMAT RULES:
- Output must be a valid Python list of tuples
- Each tuple must be ("Speaker 1", "text") or ("Speaker 2", "text")
- No empty lines between tuples
- No markdown code blocks

EXAMPLE OUTPUT:
[
("Speaker 1", "Let me explain how this technology works in simple terms."),
("Speaker 2", "[laughs] That would be great! I'm really curious about the technical details."),
("Speaker 1", "The key point is that we're using advanced algorithms to process the data."),
("Speaker 2", "Hmm, interesting. How does that compare to traditional methods?")
]

Please rewrite the provided transcript following these guidelines exactly."""
REWRITE_USER_PREFIX = "Please rewrite this transcript into a more natural conversation:\n\n"
REWRITE_TEMPERATURE = 1.0
REWRITE_MAX_TOKENS = 4000
REWRITE_STREAM = False

# Response handling
OK_STATUS = 200
PREVIEW_TRANSCRIPT_CHARS = 500
PREVIEW_TEXT_CHARS = 50
PREVIEW_ELLIPSIS = "..."

# Reply parsing
CANDIDATE_PREFIX = '("Speaker'
CANDIDATE_SUFFIX_COMMA = '"),'
CANDIDATE_SUFFIX = ")"
REPLY_JOIN = ", "

# Speakers and voices (provider, speaker, voice)
SPEAKER_1 = "Speaker 1"
SPEAKER_2 = "Speaker 2"
VOICES = [
    ("openai", "Speaker 1", "alloy"),
    ("openai", "Speaker 2", "echo"),
    ("bark", "Speaker 1", "v2/en_speaker_9"),
    ("bark", "Speaker 2", "v2/en_speaker_6"),
]

# Episode timelines (milliseconds)
INTRO_MS = 2000               # room-tone intro (dynamic variant)
INTRO_FADE_IN_MS = 1000
OUTRO_FADE_OUT_MS = 2000
FIRST_CROSSFADE_MS = 500      # first appended segment (dynamic variant)
BASE_CROSSFADE_MS = 300       # different speaker / fixed crossfade
SAME_SPEAKER_FACTOR = 1.5     # same speaker: min(500, 300 * 1.5)
MAX_CROSSFADE_MS = 500
GAP_MS = 500                  # pause before every segment after the first
PAUSE_MIN_MS = 200            # random pause after a crossfaded segment
PAUSE_MAX_MS = 800
MIN_AMBIENCE_MS = 1000        # shorter audio has no room tone (fails)

# Pacing (seconds)
CLEAN_PACE_S = 0.1
SEGMENT_PACE_S = 1.0
OPENAI_MIN_PACE_S = 0.5
OPENAI_PACE_CHARS = 1000

# Audio processing
SAMPLE_RATE = 24000
PCM_MAX = 32767
PCM_MIN = -32768
NORMALISE_HEADROOM_DB = 0.1
LOW_PASS_HZ = {"Speaker 1": 4000, "other": 5000}
HIGH_PASS_HZ = {"Speaker 1": 100, "other": 150}
SEGMENT_COMPRESSOR = (-20.0, 2.5, 5.0, 50.0)    # threshold dB, ratio, attack ms, release ms
MASTER_COMPRESSOR = (-15.0, 1.5, 10.0, 100.0)
ROOM_VOLUME_DB = -50.0
INTRO_ROOM_VOLUME_DB = -45.0
ROOM_JITTER_DB = 3.0
ROOM_SLICE_MS = 1000
ROOM_SLICE_CROSSFADE_MS = 50
RATE_JITTER = (0.95, 1.05)
PITCH_JITTER = (-0.5, 0.5)

# Export manifest
EXPORT_FORMAT = "mp3"
EXPORT_BITRATE = "192k"
EXPORT_FILES = {"openai": "_podcast.mp3", "eleven": "final_podcast.mp3", "bark": "_podcast.mp3"}
EXPORT_TAGS = {
    "title": "AI Generated Podcast",
    "artist": "OpenAI TTS",
    "album": "AI Podcasts",
}
DATE_FORMAT = "yyyy-MM-dd"
# ------------------------------------------------------------ end fixed values
