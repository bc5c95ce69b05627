"""Fixed word lists that define results."""

# Words left out of term weights.
STOPWORDS = (
    "the a an and or but if then else when at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further of is are was were be been being have has had do does did this that "
    "these those i you he she it we they them his her its our their as so than too very can will just not no nor only own same "
    "such s t don now there here"
).split()

# Function words that mark a language.
LANGUAGE_MARKERS = {
    "English": "the and of to in is that it for with as was".split(),
    "Spanish": "el la de que y los las en un una por con".split(),
    "French": "le la de et les des un une que dans pour est".split(),
    "German": "der die das und den ein eine ist mit auf für nicht".split(),
    "Portuguese": "o a de que e do da em um uma para com".split(),
    "Italian": "il la di che e un una in per con non sono".split(),
}

# Words that signal a kind of content.
CATEGORY_SIGNALS = {
    "technical/code": "function class return import variable code api method compile async struct def".split(),
    "finance": "revenue profit cost budget invoice payment tax financial quarter expense balance account".split(),
    "legal": "agreement party hereby clause liability terms contract law shall pursuant jurisdiction warranty".split(),
    "correspondence": "dear regards sincerely hello thanks email reply meeting subject sent message hi".split(),
    "academic": "research study hypothesis results conclusion abstract method analysis figure citation experiment data".split(),
    "marketing": "product customer brand campaign launch market sales offer audience growth engagement conversion".split(),
}
