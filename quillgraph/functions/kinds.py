"""Node kinds of the graph model.

Fixed values: the names and their grouping are the vocabulary that rules are written in.
"""

EXPR = """
Call Assign BinaryOp UnaryOp TernaryOp Cast Subscript MemberAccess LambdaDef NewExpr DeleteExpr SizeofExpr Identifier
Literal TypeRef Yield Await Comprehension NamedExpr CollectionExpr ReceiveExpr TypeAssertion CompositeLit SwitchExpr
InstanceofExpr MethodRef NewArray ArrayInit ClassLiteral ThisExpr AwaitExpr YieldExpr TemplateStr SpreadExpr
OptionalChain JsxElement SequenceExpr AsExpr NonNullExpr SatisfiesExpr MatchExpr ClosureExpr TryExpr LoopExpr RangeExpr
StructExpr BreakExpr
""".split()
STMT = """
Block Return Loop Conditional Switch Case SwitchDefault Break Continue Goto Label Throw Try Catch ExprStmt Import With
Assert Delete Global GoStmt DeferStmt SelectStmt SendStmt ShortVarDecl IncDecStmt Fallthrough TypeSwitch Synchronized
Finally UseDecl ModDef SehLeave
""".split()
DECL = "ParamDef LocalDef FieldDef MethodDef ClassDef TypeAlias".split()
#: Types that a binding may name beside the four groups Node, Expr, Stmt and Decl and NodeType("raw").
NAMED = """
Call MethodDef ClassDef Identifier Literal Assign BinaryOp Return Loop Conditional Block Try Catch ParamDef LocalDef
FieldDef MemberAccess Subscript Cast GoStmt DeferStmt MatchExpr Comprehension Await Yield UnsafeBlock ImplBlock
""".split()
#: Callees that may return null.
NULLABLE_CALLS = """
malloc calloc realloc reallocarray aligned_alloc valloc memalign posix_memalign strdup strndup wcsdup strstr strchr
strrchr memchr memmem fopen fdopen freopen popen tmpfile opendir getenv getenv_s getcwd realpath inet_ntoa dlopen dlsym
mmap shmat bsearch lfind lsearch g_malloc g_try_malloc g_try_malloc0 g_realloc g_strdup g_strndup kmalloc kzalloc vmalloc
kvmalloc HeapAlloc GlobalAlloc LocalAlloc VirtualAlloc VirtualAllocEx
""".split()


def kinds_of(type_name: str) -> list[str] | None:
    """Kinds that a type stands for; None for all of them."""
    if type_name in ("Node",):
        return None
    groups = {"Expr": EXPR, "Stmt": STMT, "Decl": DECL}
    if type_name in groups:
        return groups[type_name]
    return [type_name] if type_name in NAMED else None
