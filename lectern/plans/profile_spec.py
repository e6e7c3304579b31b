"""The nested candidate record, as the visitor of ``operators.nested`` reads it."""

from lectern.operators.nested import Node, Spec

EVIDENCE = Node("evidence", one=True, text_key="quote")
IDENTITY = Node(
    "identity",
    one=True,
    table=False,
    children=(
        Node("full_name", ("name",), text_key="value", children=(EVIDENCE,)),
        Node("emails", ("email",), leaf=True),
        Node("phones", ("phone",), leaf=True),
        Node("links", leaf=True),
    ),
)
EDUCATION = Node("education", ("educations",), text_key="degree", children=(EVIDENCE,))
SKILLS = Node("skills", children=(EVIDENCE,))
PROFILE = Spec((IDENTITY, Node("experiences", text_key="title", children=(EVIDENCE,)), EDUCATION, SKILLS))
REPLY = Spec(
    (
        IDENTITY,
        Node("experiences", ("experience", "work_experience"), text_key="title", renamed=(("company", "organization"),), children=(EVIDENCE, Node("projects"))),
        EDUCATION,
        SKILLS,
    ),
    wrappers=("result", "candidate"),
    fenced=True,
)
