"""Names that column expressions and plain Python share."""

#: Built-in functions, in the order in which their calls are listed.
BUILTINS = ("$rose", "$fell", "$stable", "$changed", "$past", "$onehot", "$onehot0", "$isunknown", "$countones", "$sampled", "$bits")

BUILTIN_MEANINGS = {
    "$rose": "Signal transitions from 0 to 1 (rising edge)",
    "$fell": "Signal transitions from 1 to 0 (falling edge)",
    "$stable": "Signal value remains unchanged from previous cycle",
    "$changed": "Signal value changes from previous cycle",
    "$past": "Reference to signal value from previous cycles",
    "$onehot": "Exactly one bit is set in the signal",
    "$onehot0": "At most one bit is set (all zeros allowed)",
    "$isunknown": "Signal contains unknown (X) values",
    "$countones": "Count the number of 1 bits in the signal",
    "$sampled": "Sampled value of signal in the current clock cycle",
    "$bits": "Number of bits in the signal",
}

OPERATOR_MEANINGS = {
    "##": "Cycle delay operator",
    "[*": "Consecutive repetition",
    "[->": "Goto repetition (non-consecutive with final match)",
    "[=": "Non-consecutive repetition",
    "throughout": "Condition holds throughout sequence",
    "within": "Sequence completes within another",
    "intersect": "Sequences start and end together",
    "and": "Both sequences must hold",
    "or": "At least one sequence must hold",
    "not": "Negation of sequence/property",
    "first_match": "First successful match of sequence",
    "if-else": "Conditional sequence selection",
}

#: (construct, description) by category; a construct is counted wherever its text stands, so `until` counts within `until_with` too.
CONSTRUCTS = {
    "Property Operators": {
        "|->": "Overlapping implication", "|=>": "Non-overlapping implication", " and ": "Property AND", " or ": "Property OR", "until": "Until operator",
        "until_with": "Until with operator", "not ": "NOT property", "disable iff": "Disable iff", "if ": "If-else property",
    },
    "Sequence Operators": {
        "##": "Delay operator", "[*": "Consecutive repetition", "[=": "Non-consecutive repetition", "[->": "Goto repetition", "intersect": "Intersect operator",
        "throughout": "Throughout operator", "first_match": "First match", ".ended": "Sequence ended",
    },
    "System Functions": {
        "$rose": "Rose function", "$fell": "Fell function", "$stable": "Stable function", "$changed": "Changed function", "$past": "Past function",
        "$onehot": "Onehot function", "$onehot0": "Onehot0 function", "$isunknown": "Is unknown function", "$countones": "Count ones function",
    },
    "Boolean Operators": {"&&": "Logical AND", "||": "Logical OR", "!": "Logical NOT"},
    "Comparison Operators": {
        "==": "Equality", "!=": "Inequality", "===": "Case equality", "!==": "Case inequality", ">": "Greater than", "<": "Less than", ">=": "Greater or equal",
        "<=": "Less or equal",
    },
    "Arithmetic Operators": {" + ": "Addition", " - ": "Subtraction", " * ": "Multiplication", " / ": "Division", " % ": "Modulo"},
    "Bitwise Operators": {
        " & ": "Bitwise AND", " | ": "Bitwise OR", " ^ ": "Bitwise XOR", "^~": "Bitwise XNOR", "~^": "Bitwise XNOR alt", "~": "Bitwise NOT",
    },
}
