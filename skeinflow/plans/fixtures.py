"""Sentences and conversations of our own for rules that the driver's invented prose never triggers."""

from __future__ import annotations

TEXTS = [
    "I work as a nurse in Antwerp. My shift starts at 7:30 on Monday!", "Well, I live in an old house near the canal, and it is cold.", "Do you like chess? I play chess with my sister Marta.",
    "You should rest more. I told you about my brother.", 'She said "Go home. Now, please." and left the meeting at 10:00.', "The deadline for team 5 is March 3rd; the deadline for team 7 is in April.",
    "I'm allergic to peanuts and I've a dog named Rex.", "We are using the heron-nest cluster, but we deploy from the VPN.", "note: my flight KL1234 leaves on Friday", "Oh hey, by the way I prefer green tea.",
    "ok", "  ", "we have two projects\nour manager is Priya", "I am running and stopped planning the falling class bus", "The cooking of animals is not safe, therefore avoid it.", "What is the name of the user's dog?",
    "My neighbour's cat sleeps all day while I review contracts, though I never complain.", "“I never lie,” he said. ‘Yes. No.’ It was late.", "It took twelve months and one hundred forms. Remember the budget!", "Invoice #42 was paid: thanks",
]
#: (first, second, whether the second corrects the first)
PAIRS = [
    ("the user lives in Antwerp", "the user lives in Ghent", 1), ("the user has a meeting on Monday", "the user has a meeting on Friday", 1), ("the deadline is March 3rd", "the deadline is April 9th", 1), ("team 5 has a deadline", "team 7 has a deadline", 0),
    ("the user plays chess", "the user plays the piano", 0), ("flight KL1234 leaves on Friday", "flight KL5678 leaves on Friday", 0), ("the user works as a nurse", "the user works as a teacher", 0), ("the user is allergic to peanuts", "the user is vegetarian", 0),
]
CONVERSATION = [
    ("user", "I live in Antwerp."), ("assistant", "Noted."), ("user", "My sister Marta has a dog named Rex. I work as a nurse."), ("user", "I live in Ghent now."), ("assistant", "Good."),
    ("user", "The project deadline is on Friday."), ("user", "I live in Antwerp."), ("user", "The project deadline is on Monday."), ("user", "My email account is marta-7."), ("user", "I play chess with my sister."),
]
#: Conversations that are observed, so their facts are extracted; ids below zero. The first is the one above, with a question at its end.
OBSERVED = {
    -1: [*CONVERSATION, ("user", "What is the name of my sister's dog?")],
    -2: [("user", "My locker code is 4417 and I keep it secret."), ("Carmen", "I grew up in Lisbon. You should visit Lisbon."), ("user", "We deploy from the heron-nest cluster on Friday!"), ("Carmen", "I have two brothers, Tomas and Rui."),
         ("user", "The code for my locker is 9023 now."), ("user", "Do you remember where Carmen grew up?")],
    -3: [("user", "I am allergic to peanuts."), ("assistant", "Thanks, noted."), ("user", "My flight KL1234 leaves on Monday; my boss is Priya."), ("user", "Something else entirely?")],
    -4: [("user", "What now?"), ("assistant", "Nothing."), ("user", "And then?")],
}
#: Their facts by hand: (conv_id, turn, place in the turn, text).
FACTS = [(-1, 0, 0, "the user lives in Antwerp"), (-1, 2, 0, "the user's sister Marta has a dog named Rex"), (-1, 2, 1, "the user works as a nurse"), (-1, 3, 0, "the user lives in Ghent now"), (-1, 5, 0, "The project deadline is on Friday"),
         (-1, 6, 0, "the user lives in Antwerp"), (-1, 7, 0, "The project deadline is on Monday"), (-1, 8, 0, "the user's email account is marta-7"), (-1, 9, 0, "the user plays chess with the user's sister"),
         (-2, 0, 0, "the user's locker code is 4417"), (-2, 1, 0, "Carmen grew up in Lisbon"), (-2, 2, 0, "the team deploy from the heron-nest cluster on Friday"), (-2, 3, 0, "Carmen has two brothers, Tomas"),
         (-2, 4, 0, "The code for the user's locker is 9023 now"), (-3, 0, 0, "the user is allergic to peanuts"), (-3, 2, 0, "the user's flight KL1234 leaves on Monday; the user's boss is Priya")]
QUESTIONS = [(1, "Where does the user live?", ["antwerp", "ghent"], "direct"), (2, "What is the name of the pet?", ["rex"], "hypernym"), (3, "When is the deadline?", ["monday", "friday"], "direct"), (4, "Who repairs the boat?", ["nobody"], "absent"),
             (5, "Does the user have a hobby?", ["chess"], "hypernym"), (6, "How do I reach the user?", ["email"], "consequence")]


def rows(d, items) -> str:
    def one(v):
        if isinstance(v, str):
            return d.text(v)
        if isinstance(v, list):
            return d.array(*map(one, v))
        return str(v)

    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in items)


def texts(d) -> str:
    """(id, text): all turns of the conversations, and the sentences above with negative ids."""
    own = d.values(rows(d, [(-k - 1, t) for k, t in enumerate(TEXTS)]), "id, text")
    return f"(SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS id, text FROM conversations UNION ALL SELECT CAST(id AS BIGINT), text FROM {own} o)"


def own_turns(d) -> str:
    """(conv_id, turn, role, text) of the conversations that are observed."""
    own = d.values(rows(d, [(c, k, r, t) for c, turns in OBSERVED.items() for k, (r, t) in enumerate(turns)]), "conv_id, turn, role, text")
    return f"(SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM {own} o)"


def turns(d) -> str:
    """(conv_id, turn, role, text) of all conversations: those of the table, whose sentences are added as they are, and those that are observed."""
    return f"(SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations UNION ALL SELECT * FROM {own_turns(d)} w)"
