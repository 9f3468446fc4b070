"""Texts that every operator has to cope with."""

ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "One. Two, three!",
    "one. two, three!",
    "ÉCOLE naïve ²³ Ⅷ ٣ 日本語 🤗🤗",
    "it's they'll 's ''s\n\n  x\r\n",
    "<|endoftext|> in a text <|startoftext|>",
    "a\x00b \x1c c",
    "word " * 5000,
    "All rights reserved.\nLicensed under CC BY-NC 4.0.",
]
