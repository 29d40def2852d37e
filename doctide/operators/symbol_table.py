"""Mathematical symbols."""

#: Symbols and their LaTeX commands.
SYMBOLS = {
    "◦": r"\circ", "∗": "*", "∞": r"\infty", "Ω": r"\Omega", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma",
    "δ": r"\delta", "ε": r"\varepsilon", "ζ": r"\zeta", "η": r"\eta", "θ": r"\theta", "ι": r"\iota", "κ": r"\kappa",
    "λ": r"\lambda", "μ": r"\mu", "ν": r"\nu", "ξ": r"\xi", "π": r"\pi", "ρ": r"\rho", "σ": r"\sigma", "τ": r"\tau",
    "υ": r"\upsilon", "φ": r"\varphi", "χ": r"\chi", "ψ": r"\psi", "ω": r"\omega", "Γ": r"\Gamma", "Δ": r"\Delta",
    "Θ": r"\Theta", "Λ": r"\Lambda", "Ξ": r"\Xi", "Π": r"\Pi", "Σ": r"\Sigma", "Υ": r"\Upsilon", "Φ": r"\Phi",
    "Ψ": r"\Psi", "∈": r"\in", "∉": r"\notin", "⊂": r"\subset", "⊃": r"\supset", "⊆": r"\subseteq", "⊇": r"\supseteq",
    "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "≡": r"\equiv", "∼": r"\sim", "≃": r"\simeq",
    "≅": r"\cong", "∝": r"\propto", "→": r"\to", "←": r"\leftarrow", "↔": r"\leftrightarrow", "⇒": r"\Rightarrow",
    "⇐": r"\Leftarrow", "⇔": r"\Leftrightarrow", "↦": r"\mapsto", "↪": r"\hookrightarrow", "↠": r"\twoheadrightarrow",
    "×": r"\times", "÷": r"\div", "±": r"\pm", "∓": r"\mp", "⊗": r"\otimes", "⊕": r"\oplus", "∩": r"\cap", "∪": r"\cup",
    "∧": r"\wedge", "∨": r"\vee", "∘": r"\circ", "·": r"\cdot", "†": r"\dagger", "‡": r"\ddagger", "∀": r"\forall",
    "∃": r"\exists", "∄": r"\nexists", "¬": r"\neg", "∅": r"\emptyset", "∂": r"\partial", "∇": r"\nabla", "∫": r"\int",
    "∑": r"\sum", "∏": r"\prod", "√": r"\sqrt", "⊥": r"\perp", "∥": r"\parallel", "⟨": r"\langle", "⟩": r"\rangle",
    "⌊": r"\lfloor", "⌋": r"\rfloor", "⌈": r"\lceil", "⌉": r"\rceil", "♭": r"\flat", "♯": r"\sharp", "♮": r"\natural",
    "ℓ": r"\ell", "ℕ": r"\mathbb{N}", "ℤ": r"\mathbb{Z}", "ℚ": r"\mathbb{Q}", "ℝ": r"\mathbb{R}", "ℂ": r"\mathbb{C}",
}
