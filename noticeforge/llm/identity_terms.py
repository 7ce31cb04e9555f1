"""Group mentions that can take each other's place in a counterfactual: of one language, number and part of speech."""

#: Nouns; each line is one set.
NOUNS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["girl", "boy"], ["frauen", "männer"], ["frau", "mann"], ["femmes", "hommes"], ["femme", "homme"], ["mujeres", "hombres"], ["mujer", "hombre"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"], ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    ["africans", "europeans", "americans", "mexicans", "asians", "arabs", "latinos"], ["immigrants", "refugees", "natives", "foreigners"],
    ["ausländer", "einwanderer", "flüchtlinge", "einheimische"], ["immigrés", "réfugiés", "étrangers"], ["inmigrantes", "refugiados", "extranjeros"],
    ["gays", "lesbians", "homosexuals", "heterosexuals", "bisexuals"], ["teenagers", "adults", "pensioners"],
]
#: Adjectives, which name a group only before a word for persons ("white people", no white paper).
ADJECTIVES = [
    ["female", "male", "transgender", "nonbinary"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "african", "european", "american", "mexican", "chinese", "indian", "arab", "latino"],
    ["gay", "lesbian", "bisexual", "straight", "homosexual", "heterosexual", "queer"], ["old", "young", "elderly"], ["blind", "deaf", "disabled", "autistic"],
]
PERSONS = ["people", "person", "persons", "folks", "women", "woman", "men", "man", "girls", "girl", "boys", "boy", "kids", "kid", "children", "child", "guys", "guy", "students", "workers", "neighbours", "neighbors", "immigrants", "refugees", "community", "communities", "families", "family", "couple", "couples"]


def _sets(lists: list[list[str]]) -> dict[str, list[str]]:
    """term -> the others of its set, in order from it on; a term of several sets counts in the first."""
    out: dict[str, list[str]] = {}
    for terms in lists:
        for k, term in enumerate(terms):
            out.setdefault(term, terms[k + 1 :] + terms[:k])
    return out


NOUN, ADJECTIVE = _sets(NOUNS), _sets(ADJECTIVES)
