"""Operations of a training-data pipeline; nothing outside this subpackage imports it.

What holds for every operator: a null text counts as empty; an empty table gives an empty result;
texts are read whole, however long; columns that an operator doesn't use pass through where it
returns the rows of its input, and those named like its output are replaced. Names that start
with _llm_ are its own. What a null id, ties and repeated rows mean is said at each operator.
"""
