"""English words, most used first: those of four letters or more in two or more of the help texts and licenses
installed with Python and this system, ranked by the number of texts that use them."""

from __future__ import annotations

# fixed values: the words
PLAIN = """
this with returns that from return value parameters class will name examples used when default object also which list data function true string given file
values only type none should number have using each other optional index copyright version import same versionadded false method spark code must into array
input more example files source column first without python documentation whether notes text then where format specified otherwise path software either result
https there these create names output instance error note args than bool does details some license dtype such copy case current argument following check
module after functions found returned arguments free they instead called provided line series single information support user debian like both time option
call test before read make objects order passed since columns sets contains http your release been numpy types permission under message param even tuple
library supports include work directory common containing exception options implementation based pyspark including useful package public elements write their
them integer multiple empty uses above available raises system between different most strings binary modify size part written defined over command added need
last original parameter process required convert would general while being form about dict length model self possible included specific table start node
always element created distribution standard connect versionchanged methods because content defaults except versions later mode along sequence change
supported valid apply equivalent reference attr additional associated full header left generated ndarray cannot field base already just bytes pygments systems
share corresponding boolean another unless buffer pandas those upstream internal rights terms within changes float memory match program usage notice errors
style many find context build dictionary currently what configuration axis want pass meth open through right allow point next deprecated variable well target
merge remove fixes attribute raise attributes local section level complete generate removed here raised means conditions made expression keys document long
group main representation back provides character existing were similar however lines subject running distributed zero compute func copies schema please
characters contain request fields language handle could state encoding interface provide below special modules else results update directly named display
users resulting server keyword calling arrays missing event works once packaging parse link operation second itself allows take specify windows done stream
calls necessary contents expected against needed team distribute built access foundation domain null maximum avoid setting behavior allowed features various
every automatically custom description tree project received implied item performance position environment invalid scalar cases during related script still
label shape config docs tests prior width updates simple date least warning present equal reserved rows doctest granted linux takes appear extra includes
representing items limitation range warranty converted writing instances classes future search whose github query redistribute place runtime lists modified
purpose underlying variables ignored makes prefix previous mark hereby published status shall help report core matches body less compatibility console changed
operations packages show fixed mapping window contained perform deal pattern protocol block control passing times application explicitly metadata connection
root lexer portions appropriate replace known title info issues large entry certain creates gets helper matching print rather require initial person hope
ensure location unique restriction property exists recent until numbers particular address exist represents requires callable security sell authors collection
derived load entries keep publish separate entire depending page global individual considered define modification very might relative side permitted subclass
comment licenses tools close permit longer obtaining charge filename implement messages applied repository send substantial exceptions points sorted
references requests checks unicode forms three updated never parent specifies whom addition stored around author html indices attempt install response enable
paths active cause correctly installed correct needs persons according meta compatible feature override datetime creating execution flag split stop syntax
alias shared sublicense extension working cache failed limit sure furnished parsing starting handling headers reading skip neither parser definition follow
sort iterator outside promote look minimum others disclaimer real testing applications development computed action assert construct constructor further
timestamp ignore regular negative wrapper byte color actual offset stack determine normal count gives redistribution filter products kind labels small
described experimental mask applies refer inside reproduce nothing statement archive several conversion permissions produce something thread pair releases
perl retain specifying callback indicates issue iterable numeric store usually taken contributors generator summary view bugs checking treated adding hook
replaced socket space better having actually platform clean algorithm bound loop processing specification hash host clear home adds intended static charset
exit fill implemented inputs sources tuples client const licensed latest making signature structure anything directories greater identifier returning port
events integers logic handler together explicit multi parsed commit frame effect indicate therefore widget accept failure properties fail much scripts stable
daniel fails rules basic descriptor give indicating whole kwargs literal random resource enabled though exactly external extract ones execute manual ordered
unlike complex converts java arbitrary able operator child generic namespace previously parts validate initialize params save limited marked session things
nested accepts compiled head product term zlib engine immediately redistributions debugger private upon scope follows href pairs final mechanism struct best
caller requested sample seconds traceback building libraries record lower recommended closed compile delete encoded matrix executable modifications extensions
math projects strict unknown mean optionally pydantic total beginning commands materials branch disable programs third typically flags generates history
manager minor height advertising checked configure fully lesser machine represent absolute thus doing older apache accepted diff earlier larger runs consider
remote corporation leading reason vector again crypto legacy prevent unix debugging know strategy express disabled formats supplied across double endorse
reports reset select span compiler internally mail member precision processes font problem high determined executed floor obtain applicable async good listed
short char edit move dataset timeout condition native abstract canonical invoked register validation difference verify depends places preserved remaining sign
subsequent tags changing compare receive sent supporting requirements switch wrap floating loaded pointer pull push stability trailing david fast simply step
fetch implementations indexes started temporary fallback produced settings auto behaviour expressions functionality levels blocks device michael copied
omitted positive registered throw comparison embedded released transform warnings handles reads symbols tool links occurs starts calculate decimal direct
generally nodes year copying database dtypes forward symbol wiki computes union backward break configured designed performed void choose possibly regression
threads exclude higher boston broken definitions patches world properly subset undefined constant fifth resolve alternative cluster enough often sale thrown
blob creation groups platforms readable detect distributions token followed globals normally operating align cast center comments defines dependencies graph
meaning decorator down evaluate franklin shell assumed keywords languages purposes stylesheet words worker hooks likely origin tracking turn developer
obtained reported desired extended interval readline trace documented formatted google masked network selected template append installation track ways grant
handled independent specifically suitable choice component family init lookup partition policy unsigned whitespace continue drop duplicate important nodejs
pool requirement safe utilities axes bits front hidden implements lambda streams white wrong components pytest util exact getting restrictions writes assume
notices reduce responsible tracker codes consistent debug downloaded patch proxy rule service university providing relevant site loading prints sequences
slice wait download prepare force progress resources applying arrow dimensions interpreted preferred replacement authorization dimension export identical
occur placed reporting shows stdout compilation encode insert navigation problems records timezone turtle enables come decode freq represented signal aliases
channel gmail lang people refers yield altered clone introduced libxslt martin shown spaces dynamic faster removes timers vectors aggregate assigned computer
paragraph queue sometimes terminal appears combination compression sections john removing resolution subclasses asynchronous covered enum image lexers theme
although amount button categories especially pyarrow respect selection accessed regex serialization commits formatting rtype catch categorical join
programming redhat maintained moved rest whatever word developers legal logo really terminate wrapped convenience everything finally james margin padding
utility backend coefficients contrib logging scheme seen virtual visible dates extend makefile probably promise punycode respectively spec speed category
incorrect initialization limitations major potentially california emit eric indicated kernel cross describe merges positional processed controls easier
initialized locale representations smaller stderr alternatively compliance expect retrieve taking affect documents emitted hold inspector newer optimized
setup background causes commercial ends meant throws become builtin early fixture members post rename repeated resolved retained trying xmlns combined decoder
holds plain proper remain binaries combine email kept printed themselves account excluding intel parses streaming allowing assertion counts derivative
developed dist improved storage transfer basis detail generation incorrectly render suite upper approach checkout completion evaluation ints manually depend
peter signed andreas escape freely happens layout recursively similarly specifier task clause comes imported minimal parallel tell typing unchanged weight
bindings days incompatible looks menu plugin refs thing unit alice filled maps periods tokens tries unused certificate generating installing iteration caused
maintainers middle callbacks expat frequency guaranteed inherit master royalty cached disk optimize performs seed additionally appended authentication
corepack deleted going guide hello human rebase round addresses buffers chain differences evaluated whenever architecture logical mostly plus relation reverse
suffix yields accessible attached border builds conflict constants dependency hypothesis identified operators pretty regents among easy sense cleanup
connections json macro mailing mapped overridden primary separator statements symbolic truncate becomes duration linked overflow richard accessing codec
compared determines filesystem implementing password polynomial semantics treat agreement corresponds highlight improvements invoke opened verbatim attempts
bind material newly partitions patterns period steps interpreter priority regardless direction formatter giving latter overwrite preserve variant chunk
converting extent four mike normalized outputs corrected dataframe fall organization prepared quite screen tasks transport vary affected christian pack
partial plugins separated success successfully tracing bounds depth hard instructions linear looking power restore saved strictly wish assign batch comma
compressed contributions lost reasons sending stdio intro little scale submodule archives held matthias passes plan states tied writable collected completely
excluded paul prompt solaris sparse synopsis thanks warn wrote attempting merged pages publicity recursive simon submit terminated thomas unsupported
completed describing holder interactive shift structures actions assumes container effective finished inferred matched matter modern tensor xsldbg adjust
attention blank clearly digits management month necessarily overrides pertaining termination abort constructors contributed decoded detailed improve party
warranties browser chosen failing incorporated indexing ordering revision strong usual calculated claim cursor dealings grants identify interfaces iterate
normalize skipped structured transitional trigger computing inner located receiving scott subdirectory alter anyone binding duplicates grep linking routines
styles begin bold cover dependent handlers happen mentioned pipe quoted remains scalars sends sorting transformation adam aware backwards decide defining
differ duplicated lead leave notation reasonable reuse technology away changelog collect expand omit portion reject ubuntu advanced argv expressed flattened
implicitly optimization removal tutorial unnecessary andrew descriptors destination downloads inverse locations loose past produces reader texinfo wraps
allocated broadcast hostname internet patent patents practice ready accuracy addons consortium decoding describes easily efficient enabling interpret
licensing medium models newline potential protection rejected wrapping artistic assuming chris editor ever incomplete lazy locally silently transformed
weights annotations defer factory failures internals introduction renamed showing unexpected viewport await degree docstring dropped dynamically maintain
significant translate translation typed upgrade behave constructs diagnostics gitlab news numerical occurred preference tempfile timestamps valign waiting
chunks colors computation detected displayed garbage intermediate marks originally registers serialized triggered zeros assignment beyond branches colin
distinct entirely exposed icon mixed namespaces replacing runner successful tested truncated usable alternate arithmetic asked comparing coordinates cpan
loader modifying operate pointers statistics street targets zone bgcolor calculation correspond damages extends fonts highest inspect profile propagate rich
stated thereof arising connected constructed embedding fortran hence inclusive inline intl logger manner pathname performing stdin debianized english
framework onto questions receives stuff tables turns annotated automatic bash compiling convention evaluates expose maintenance media prev rely storing
technical templates think tried boundary controlled javascript maybe standards stdlib toggle children design ensures milliseconds moving noted outer owner
trademark underline validator veillard allocation collections discussion enforce explain filling goes printf recently reduced satisfy sizes suppress timedelta
care determining exported indexer infer loss opening openssl printing promises quotes repl slow square tbody vlink annotation confused declared dedicated edge
exclusive extracted infinite inserted instruction issued keeping liable online portable primarily reflect robert role slightly stops closing encountered
filenames inplace learned letter liability listener obsolete qualified referenced said segment sockets wheel begins builder capture deprecations fewer finding
floats ignoring mixin pipeline precedence prefer regarding registry restricted stopped transforms alexander average causing cellspacing company compilers
deprecation digital distributing exports finish heap lack libstdc misc offsets particularly pseudo translated trivial unmodified username algorithms
cellpadding cols deep expanded gitweb herein lock prediction protected rewrite twice wants careful copyrighted declaration diagnostic hans hide holding indent
integration jean largest mistake occurrence proto rate signals updating agreed allocate cost dark executing hardware honor light loads manage managed
polynomials processor production publicly question replaces responsibility retrieved safely sourceforge understand years almost alpha ambiguous anymore
consists constraints effort entity equality flush guarantee imports indirect keeps marker naming offer pending separately tells unlimited workaround
consistency directive exits implicit paragraphs percent pure situation texts verbose xslt alone anyway complexity dgram draw environments fact governing
government gzip hierarchy leaving limits markup notwithstanding overview pieces procedure risk serialize shallow stores strip utils accesskey approximate
compress continuous convenient counter dave declare expensive formed gnome idea importing initializer international multiplication ranges recommend upload
variance bare breaking construction detection fine indexed involved jeff machines macros overhead pascal pickle pointing repositories resolving smallest
stefan articles attempted behaves coefficient conflicts deemed finds flow green interest jason official rank sebastian threshold wide argc communication
correctness course dialog executables factor hand libxml microsystems packard parties prototype respective samples solution autoconf bottom catalog claims
community dealing elsewhere escaped hints identifying parquet reached servers sufficient synchronous told ability area ascending boundaries candidate
comparisons filters highlights identifiers institute invocation payload plot quantization querystring remainder revert rewritten solely steve trees writer
aligned benjamin contact differs embedder expects guess impossible josh positions reused specifiers steven training unspecified validated visibility apple
benefit business consumed encodes epoch fatal glibc guarantees highlighting implies indentation localhost nicolas research shrink typical week alignment
cherry compact holders lowest marc miller misrepresented ownership pinned plainly quote underscore werner affects agent answer contexts contributing divide
encoder eval interpolation leak phase routine secure snapshot supposed visited accordingly analysis assets attach authorized caching compat emits frames
lengths maintaining merging normalization occurrences protocols provisions services startup stat subprocess sync unavailable additions advantage choices clang
commonly continues contrast cookie delta echo explanation foreign grouping guido hint imply matplotlib meaningful repr saving units worked worldwide adapted
assembler attrs black combining cygwin dump effects flat identity introduce march operand oracle prefers producing protect restrict skipna soon submodules
timer appreciated asking breaks copyrights endif everyone immutable intact listen mainly mozilla nature pick provider symlink xmlsoft acknowledgment adjusted
clients datagram digit ending filtering helpers invariant leads literals mailbox overriding prefixed probability requiring stephen accessor aria behind brief
degrees emacs encodings enter interior modes nice nullable offered perhaps symlinks translations unnecessarily visual wasi worth acknowledgement alive blame
brian bundle carefully caught cleaned conditional consecutive constraint customize cycle declarations decorated dictionaries dicts differently displays folder
groupby half increase interaction linker partially picker pointed scan selects shortcut suitability validity achieve america backport browsers concatenated
corrupt delay descending driver entities feed figure graphics mentioning minutes overwritten persistent portability presence recorded recursion remember retry
schemes sensitive shutdown temporarily turned verification webcrypto aggregation alphabetic builtins coverage crash delimiter digest experience fashion gave
grammar increasing inherited intellectual offers packed referred repeat tabs validators workflows aborted auth book buffered closes colspan combinations
commons discarded incoming infinity january layer lxml matt nearest newlines notable queries searching splits technologies website webstreams acknowledge
analogous berkeley bugzilla codepath concept corner cygnus destroy detached falls invokes jakub kinds magic substring throughout timing accurate alternatives
anthony arial blocking cancel chars comply configurable daemon dummy entirety equals images incorporate mock ndarrays operands permissive raising sans stash
universal broke carry concatenation consult cookies draft drepper fetching fitted flexible helps histogram learn lowercase maintainer micro piece proxies
sentence shorter signatures symmetric testsuite variants xhtml abstraction avoids bitmap booleans classification dataclass drive fork grouped helvetica
instantiating jonathan kevin login mappings marking matrices microsoft modifies onnx ordinary primitive reduction segments sharing simplify skipping workers
adler anonymous architectures concerning decision exponent getopt hashable libffi live meet natural partitioning precise prohibited quantized recognized
resolver review splitting transpose acceptable captured certificates clarify forbid helpful invoking keith lars maintains national niels reasonably renderable
resolves slices tabindex uncompressed verdana welcome android apicontent apidoc cert clearfix concrete configurations conform contiguous contribute creative
devices discard division enhanced exercise friends garypennington greg gtoc hljs huge immediate initially lato machinery malformed miscellaneous patrick
regexp simplified spencer suggested tobias unset appending appropriately attribution august circumstances codespeak colon compares consist consume destroyed
disables enctype epatents fffacd fixing forgot fragment initializes iterating jurisdiction pathspec philip preceding region repo searched smart subtype swpat
transition aleksey anchor behalf cleared contract conventions corp deviation drawn estimate foregoing former gencodec independently insertion listening
mismatch policies purely puts serve situations slash someone throwing triggers xorg checker constructing copyleft effectively electronic existence expanding
focus glob impact inherits listeners porting possibility scheduled significantly somewhere stats substitute talk taught trust unstable warns bundled compliant
confusing dotted fraction governed guard heads historical hover instantiate iterations jump mechanisms parentheses physical race refresh robust selector
serious singular stage tensors acceptance closely confusion consequences counting cycles directives distinguish doko domains drawing errno essentially
filtered idle inform initializing insensitive july klose leaks maint multidimensional mutable namedtuple notify predicate procedures redirect respects
responses says simpler spawn specifications todd trademarks united cipher collecting concatenate dual eslint generators goal inference instantiation
interested interesting interoperability mandatory multiply near packaged provision quoting redirected scipy towards traditional trusted william accepting acts
availability backslash concepts credit disclaimers dpkg encryption exiting exposes fixtures grid hashes intent laws libc merchantability parents pathnames
quick referring registration reshape stale suggestions swap unpack vertical angle bootstrap casting chance circular coerce encouraged essential exec fees fsck
george heading ignores indicator instantiated jobs joined labeled lazily lemburg letters loops opposed optimizations ports quiet redistributed rejects rolling
understood unhandled views weak yourself batches brackets bring capability capturing caveats communicate conftest conversions discrete dmitry entitled finite
fitness fold frozen individually installs integrity karl leaves libexslt mkdir november perf problematic quantize recipient redundant reflog solutions stating
textual timo train uncaught uninitialized vendor vincent alex asynchronously candidates cell christopher consisting dead detecting emitting executes
inconsistent individuals integrate merely misleading observations parrot prereleases preserves quickly relationship reorder seems strategies strongly
subdirectories summarized unconditionally wanted accordance anywhere avoided belong belongs beta cells clarified constitutes converter convey escapes exceeds
exporting fits freedom goto integral johnson kill lifetime listing markers microseconds naive nick operates perpetual pypi recipients refused reliable ryan
seem sides smith subcommand supply terminates tzinfo unable wrappers approved canvas covers deleting detects disabling discuss eliminate estimator eventually
exchange federal gailly inclusion inject integrated interact interpretation julian june keyed managing missed observed opaque personal prepackaged prevents
pushing quantile repeatedly scaled schedule separators serializer sorts tick uppercase vice whereas wildcard agree andy assembly assigns attack callers
codepaths collaborators compiles complement contributor december descriptions dimensional evolving extras forces guides handful hppa josefsson licensee
ludovic malloc marco mouse novell opposite owned prefixes rendered showed stricter stripped styler suse theory typedef unsafe widgets blockquote breakpoint
claimed credential customized eliminating ended ensuring entered established fetched frequently happened hours identifies illegal intervals looked parallelism
recommendation refuse rendering reserves scoped shorthand sphinx subclassing timed trade treaty validating absence bases bitwise complicated continuing cores
corruption credits databases datatype evaluator fuse globally great hexadecimal hosts igor infringement iterates lets locals obvious pager pickled prepend
propagation scaling sessions spelling suggest topics touch transparent travis ulrich underscores achieved agrees attacks cancelled chaining chapter cloning
complain editing explained expressly fair five flatten functional intersection involving keepdims libuv licence logs managers measure nbsp nowrap ought padded
preload prominent retrieves rounded saying scientific simultaneously tagged tarball temp traces tracked transformations unrelated wire adapt basename
basically caches calculates calendar consistently department doubt enhancements escaping flaky justify libtool locate massachusetts metrics mirror pathlib
percentile prepares profiler resume revised scala segfault selecting shares singleton specialized subtree vars walters yielding assigning bypass calculating
calculations closest closure conforms creativecommons criteria decompress defects degradation discovered excludes exited henry indented knowledge knows lots
mind months placeholder posix proprietary sampling slower synchronously technically telegraph telephone truncation unfortunately unreachable variety worktree
activated ancestor apart assignments authorship bias blue collabora collaborator concurrent couple deletion dense deps distance emmanuel encourage fractional
hierarchical ings isolate lexical membership metaclass mips monkey omitting overall partitioned programlisting propagated reach revisions sean sentinel
sequential somewhat statically unpacking untracked vulnerabilities accompanying accumulated addon arise bogus buffering chebyshev checkbox checkers collector
comp compound containers contribution curve delegate despite diagonal dispatch duplex evaluating exceed forget frank greatest incurred indication inspecting
intercept iterables mention nonzero oblique predefined profiling proposal rebuild registering relying repack reproducible taylor timeouts tracks trim watch
weighted accesses activate appname backed bigint bins bruce bytecode caution chromium coming conjunction cryptographic defaulting edges falsy favor foreach
gain gained guidelines licensor lineno lint markus minus minute moment neighboring peer press regressions rejection restart roughly samuel serif shadow
spawning transferred useless vulnerability believe besides came chained consequential courtesan cumulative decodes discussed distro docbook dropna expectation
extending externally extremely gateway gettext hashing helmut hewlett highlighted irrevocable jeremy leaked measures numba paolo precompiled principal prune
publication pushed relies resets restrictive reversed scopes slicing snapshots typo unlikely visit workflow american appearance article assumption bugfixes
chrome consumption delimited deprecate derivatives discouraged downloading excel exclusion extracts feedback footer formatters freed hardening ifdef imaginary
inserting introspection killed lookups lucas manpage matthew median mergetool modifiers moshier multipart mypy obligation outstanding packfile percentage
preprocessor prerequisite preserving recognize recover regard regulations relatively retries safer seek semi sole squares succeeds topic walter widely
acknowledges advance advice brought bump clearing concerns connecting controlling coordinate coroutine datasets difficult dumb elapsed establish exercising
extraction fills fredrik freedesktop hughes hunk identification incidental indirectly intentionally invocations lennart mailto marek measured namely nettle
observation october opens outdated overlap parsers protobuf reachable saves secret setuptools subsequently successors thought unenforceable uniform versus
vulnerable waived wall yahoo zstandard academic accidentally acting alexandre alexey atomic biebl bisect central channels completes conf consumes counted
disclaims distutils engines entering expr fake falling feel filesystems fitting foreground furthermore gnat hack imap inheritance initializers inspired
interchange jose linus logged luca midx overly quality randomly reliably reproduced resulted revoked rounding satisfied schemas shuffle snippet stand stata
stefano subcommands subsystem suit surprising survive synonym traversal turning tweak validates violation xsltproc adrian afterwards allocator analyze ancient
armin ascii assertions attacker board coerced combines commas configuring datetimes decompression developing enumerate facility flaws forth freebsd gracefully
hermite iain impose improvement incremental inspection klee makeinfo misbehaved norm notably obviously omission owns predictions providers rare
responsibilities scheduling segfaulted severity standalone structs successor thead torch typofixes verifying williams xmlsec alternately authority barrier
bart bruno cloned constitute crashes dash declaring decomposition dialect eligible emulation encrypted enforced equipment expansion fairly february getter
gnupg handshake ideally interfere loewis lose manages migrate moves nesting nokia objective oliva opts packfiles play poettering preparation prepended privacy
proc programmer reflected relating roots seeing seeking serves shipped sjoerd trailer traits treats typeof unaffected upcoming verified went whatsoever
yielded addressed adjacent affiliates appeared appendix appends classic considerations considering contribs correlation customization designated diagnosed
expecting explaining falcon horizontal ideal introduces jens julien jurisdictions loaders manipulation mixing mutually pixel psdf signing sketch society
subtle tokenizer tolerance understands young aborting animal apparently assist cancellation capabilities carries certs codename conflicted conforming
consideration convertible decimals decrypt defect descriptive eggert embed estimated european exceeded expired gillmor glossary gradient imposed increment
instanceof intrinsics kahn koch learning maor mitigation notified obligations optimal orphan permits qualifier semantic shrinking spawned squared statutory
stay studio stylesheets subgraph subscribe substitution timothy todo transformer untrusted variablelist verifies waiver wording accessors alink andrey apps
arch artifacts bastian blog breakage breakpoints cartesian chunked clears coding communications contrary curl deletes deserialize dest distributes finishes
forced fragments generalized gregor historically hopefully hour informational legendre litigation llvm maarten owners population presented ratio recurse
remnant satisfies scenario semver setter sites surrogate targeted terminology titles transforming undocumented upgrading versa whitespaces aliased allocating
analyzer anders april backends benefits ciphers cline composed consuming contracts countries critical ctrl ctxt denial desirable disallow efforts emulated
enclosing extensive fuchsia gitk highly irrelevant johannes kettenis markdown morgan noqa overloaded pairwise philipp pixels plotting plug pools precisely
putting querying reducing reimplemented renders requesting retrieving sanity santiago searches sheet silicon simplest sized specially stands stopping straight
superset teardown technique thorsten threading tkinter transferring trimmed unified unions valgrind wherever abbreviation accommodate activity ahead
association benchmark bulk capable charles clark classified collects consor consumers cortex deadlock decorators defense deferred docstrings ellipsis endian
enforceable exclusively executor folding fresh fulfilled fulfills gone greatly hadoop heard incompatibility increased intend iterated japan klass klaus lacks
launched laurent life lightweight mingw nanoseconds nobody nonsense nullptr numbered opensource overwriting packet populate pretend primitives proposed
qualify queued reformed representable secondary serializable serializing stephane stub superproject takefocus terminating tium toolkit triggering unittest
unusual voluntary waives worse absent advised alleging alongside amdgcn amended barry biarch burnus centrum chains codebase completing compressor
conditionally consumer continued ctypes dedication deduction displaying duplication endorsement enumerable fifthhorseman freeing gaius hmac ifndef illustrates
importable increases indexers infrastructure insecure interacting intrinsic introducing jordi kungliga late leaf libgnat libgo libgomp libiberty libs
libxslttutorial likewise locked logos majority michal mismatches moreover multilib neoverse overflows persist phobos preparing preprocessing programmatically
recommendations refactored renaming respond russell scenarios score shapes shebang smashing sqrt stringify stripping styling subtract talking teach tekniska
tends tony torvalds truth unbounded understanding unlink verbosity violate walk widths worry absolutely administrator alessandro announcement arrangement
belonging benchmarks braces breach broadcasting cleaning converters counterclaim damage deflate derive deterministic diego efficiency enclosed engineering
fingerprint forbidden forwarded francisco iconv kwds latin lukas malicious manipulate masks milo mirrors mistakenly narrow ndim octal packing parametrized
pavel permanently pipes pobox populated ported protecting pushes reduces referencing regions reliability remotes reordering restored safety september serial
ship shut slashes slot spelled spent straightforward translates unlexed unpacked upgrades urls varies whoever zones acknowledgements acquiring adapter aligns
allocations ambiguity animation approximately awful backported blobs bradley choosing clauses cleanups clustering cmake committer confuse construed consulted
continuation customizing dateutil decisions distributors dropping examine existed extracting fourth gather gnutls govern jackson jelinek joey journal kumar
labs losses mathematical minimize monitor netherlands notification outcomes overlapping packs paper pause permissible phrase practical practices reply roberto
roman royal sandmann schwab sees serializes silent spans succeed succeeded summaries surrounding targeting theodore timezones trailers troubleshooting
unbiased undo unify variations vocabulary wheels acquisition adaptation advertise aggregated alan annotate aspect auxiliary axel backing bryan bugfix buggy
callables checkpoint cldr clicking clock coef concat counterpart court credentials cython deals decompressed demand denotes disallowed disconnect discovery
dots edition efficiently encounters endings endpoint endpoints entropy equally fixup forcing friendly gaps goals homepage hyukjin implications inadvertently
incorporates marshall matters midnight mishandled numerically octets partly pipping platformdirs positives pragma predict prerequisites preventing rarely
reaches readability refentrytitle relied rerere reverted roundoff stacktrace standardization suboptimal super switching threaded transmit undef unrecognized
unwanted violates warned wildcards yang acquire approximation asks bandwidth bunch caption christoph clarity click clip closer coded concurrently conflicting
conformance dataclasses decided denote distinguishing drivers excess exhaustion extraneous francois indeed initiatives inserts inspected installer interrupted
invalidate jenkins kukuk kurt kwon leftover literally manifest manish office outgoing overwrites owen pearson penalty persistence pierre posts prime
processors prohibits quantiles rationale raymond realloc reputation revise rewriting rightmost scanning seealso solid statistical strbuf synchronization
torsten transferable trouble truncating unclear unusable violated volume watcher watson xavier zhang agency alphabetically alumni analyzing anchors
associating backup basics beneficial bird blocked bracket casing chen clusters colormap composite confirm conn constrained controller coverity creations cruft
ddof diffs difftool dirty disclaimed distinguished distributor divisor driven drops edited encapsulates evan fcntl freeze french fundamental gaussian grow
handy hang hardcoded identically infringed initiative involves italic jeroen latent launch logistic luigi measurement mess miquel multiplied neil networks
nonexistent occurring pablo patched performances placing planned predictable preferences prevented principle rebuilt redirects refactor resize retrying sbin
shifted sliced sorry speaking stages subsection suggestion suites switches tail thierry tooling translators transmission typos unborn uniformly unintuitive
volatile zstd accumulator affecting annotating aspects automated avoiding baseline bastien bill bjorn canceled charts chmod coercion collision compose concise
corrections craig decreasing delimiters deserialized desktop devhelp diagnose dirname emulate envelope equivalents excessive expressing finalizer finder flip
flushed forked grab heavily improves indemnity inefficient inhibit inst interpolated kwarg laguerre land limiting literary manpages mitigate mutate negligence
nordhaug notebook numerous outlined passphrase porcelain posting preceded proceed prohibit prompts props publicdomain publishing rafael receiver refactoring
reproducing roland rolf rossum ruby sake science scratch signs singh spacing stockholm subtypes suffixes surface systemd terminals traverse triplett umask
unary unordered upgraded vectorized walking weekday wikipedia abandoned abbreviated accompany aggregates agreements allison allowable antoine augmented austin
bartosz bear becoming behaviors believed bidirectional blanks bools brown bunk cambridge card chunksize clasen cleanly clearer clytie compulsory consolidate
costs dashes develop differentiate dimitri discover dissemination emeriti enhance enumeration equivalence facilities factors felix fifty filehandle footnotes
glisse harder heavy heuristic holes hunks ideas illinois inflate initiate issuer ivan jerome johan jones juan kernels legally likelihood matteo metric
minimizes modifier modulo moral mount narrowing negotiation ninja nonnegative orders paint partnership ping preamble prop psser remark replacements replay
retrieval reworded rounds runtimes scanner scripted secrets silence skips solve solver sound sourceware spaced spread subroutine subscript sunday suppose
sweden telling thin thousands tomasz took transports truthy tuning ufunc uniquely unneeded waits wasm accord acquired aggregations alert anna appauthor
associate attaches behdad bother brotli buttons clarification clipboard collapse collective complying conduct cope copyrightable corrupted decides decryption
deletions disconnected equation everywhere expectations exponential fabian faith fault firefox formal forwards friedman fuzz getters googletest growing
happening harald hereof infringes inlining insight integrating isolated licensable lies lifted mailinfo marcus mimic mismatched monotonically multiline
nicholas onboarding ondrej ordinal outline pickling premature producer prototypes punctuation reasoning recording reflection regards renames responded
reusable rhys rosetta salvatore sentences sparc spell squash stacked strftime sufficiently suppressed surrounded sven synthetic thresholds tips transposed
trick tromey unaltered unregister unwrap unzip validations wishes xmldsig accelerator alejandro alphabetical anton bars became bright byteorder city clara
collins committed compensation connects consequence contextual country courts covariant crashing creator death decay density descendant designate
discriminated eager ecosystem elementwise elsif emoji exhausted exposing extern facilitate folders frac frederic frequent functools gcrypt gerhard happy
hereunder illustration importlib ineffective inexact installations intention interactively interrupt intervening investigate involve jacob kenneth khronos
lawsuit listinfo localized malfunction manuel maynard mere mert mistakes monospace natively naturally netscape nicer noordhuis obsoleted oliver organizations
overload park passwd paste pedro pertain phrases plumbing poorly powerpc propagating readonly refuses resultant ricardo ross sanin sanitizer santa sender
sensible setjmp shaw shawn similarity simons skeleton sleep squelch supplying symptom therein tort transaction treating triple triples turner unconditional
unescaped unreliable urbana vcbuild vladimir withnall abcd accelerate actively adaptations aggregating aliasing arbitrarily argparse assembled backticks
balint brad breakages changelogs codecs committee comparable concerned consent constrain consulting covariance criterion damian dated decorate decrease deeply
delivered demonstrate dereference dickey disclaim discoverable discriminator dorland downstream eddy emitter encrypt endianness enums eugene fabio fired
flavor flushes flushing footprint forever formerly forming fractions francesco frequencies frodo frontends gamma goodwill graham grained grohne guessed
hereafter horse hotmail hyphen incremented infringe joint jordan kaplan karel kartik larry linter longjmp magnitude mesa netbsd netsplit nicely noticed
outcome parameterized parenthesis performant perry phonograms plugged popular predicted printable promotion publisher publishers quant questionable queues
readers readme redirection rejections resides roger royalties rusty sampled segfaults separating sequencer sharp shells shorten shortlog simulate snell soft
sold speeding steffen stoppage stuart subpath sylvestre taint tech thai toctree today totally traditionally treatment trott tweaked unbind uncommon unintended
unquoted unrestricted uuid virtualenv wang weinberger whichever wider wilson xdiff aaron abbreviations accidental accumulate activation adopted advertised
alterations andres andries backslashes bears brouwer browse canary caret carrying caveat classmethod companion composition comprehensive consensus considers
conspicuously contributes ctor curves danishka darwin decompressor decrypted deeper demonstrating dial dienes django doug duck ease elian expands feeding
filed finer foobar gabriel gang geoffrey guidance henriksson hits igalia improving informed injection inode invisible jonas kitterman lance landing lane
latency lawrence layouts learns lifecycle locales locator loongson losing luke maciej mailmap marius monday mutated namedtuples nathan nearly nikos normalizes
obfuscation occasionally oldest ongoing optimizer peps permanent petr philippe piped preprocessed proportional qsort rational recall recreate refname refspec
refsynopsisdiv reportbug retains scheduler separation slack slots smoorenburg somehow specs substitutions superclass tarballs threadpool tokenize toolchain
tune typographical unmerged unpacks vger vietnamese visualization abbccc adams adjustment affinity algebra alike amounts anibal areas asan atom authenticate
avenue axboe backtick beobide bernstein boot broadcasts bytearray calibration carl carlos carried casagrande charged chdir chose chown classname competition
completeness compressing correction correspondence cpython culture cyclic damien dangling datetimelike dawson denis dereferenced deserialization destructor
detach dilger discussions distinction divided docfix dumps ellipses esfahbod executors familiar fastest fprintf graphical gregory hermitian hesitate hosted
hypothetical imagine improper indutny inet initialise insn institutions interpolate invert iostream isolation iterators jamey janos joins jorge jquery judged
junk kirill konstantin kzak laboratory lawyer licensees lion longest lvalue makefiles mario masking massey memcpy microsecond mikhail modular music mutual
nonexclusive numbering offering originating persch pickles piotr plotly powerful precedes presumption proven quantity rating regenerate removals revocation
reword risks rivera rubini scales scripting semantically speak stallman stateful stretch stylistic submitting subtraction summation switched thank theppitak
throughput timeseries tiny tuned ultimately usability viewer voluntarily wheeler yamato zipfile aaltonen acorn activities adhere agents alloca alphabet annex
associates backfill backporting bail bcollins binds bootstrapping bosmans brand busy canonicalize catching cheap cheung circle classifier codepoint collina
coloring commission completions concatenating considerable council cryptography curly cvsimport daylight deny depended determination dirik discourage disrupt
duvall editors elif emeritus entrypoints estimates europe exhibit expire explanations fedor fetches flexibility folded forums fourier friend geometry
glplatform hammond hayden homedir ihrig ilya imendio impurity informative injury instructs japanese jerez johnston largely larsson layers leap libgcc
libgcrypt lieu linearly linting lite localization localize logarithm logically ltoptions ltsugar ltversion mapper meets memmove memset mertdirik mitchell
mixture modula myles nabin negated nilsson opportunity paused petter pivot planning plumb pollution prepending preprocessors privileges prone pypa pytz
reconstruct recovery reflects restores signaling smuggling specializations speedup spirit spurious staging standardized strange substituted substrings
subsystems sudo syslog thru tighten tile tmpdir toplevel tracebacks transitions troy ueno uninstall unistd unmatched unwind valuable vander venue verb
versioned vertically vincenzo weakening workarounds yaml zasso zhao aborts aclocal adequate admin affirms akira algo alloc amacleod amsterdam aoeu apparatus
approaches arabic archs arief arrangements artem aside asyncio authorize automake ball barcroft believes beware bfill bigger bison bounded bourg brenta
brittle buclaw captures cares cerr chooses clones codethink cody commented configs constexpr cosine cpplint cvelbar cvsserver decompose desc detriment
dispatches documenting edward elliptic erroneous exclusions executions factorization fancy filepath finishing fisher flakiness fname fokkens fora fsmonitor
funny gccgo gfortran gladky gobjc goods grouper gtest gunnar heirs henningsen howard inevitably instruct intending jakob jamil joining karolina kerberos
keyring korsvoll laboratories lacked legend lortie ltmain macleod mammal mathematics mathematisch mathias maven messier microtask mini miroslav miss mocking
napi needing nils noise noop nvidia observe onlinedocs onnxruntime oortwijn opinions overlong packets parliament peterson plane plans plots preferably price
projection prominently propose pruned pruning quot recognised recognizes regularly regulation reis reload remotly repeating reproject riscv rotation ruben
rust rvalue samsung sandeen sane schulze scrollbar setyo shar sharif shigeki shim ships sibling sigma slide sliding spend splice srivastava standardize
stapelberg statute stefanor stichting streamed submitted subprocesses subversion suggests syscall tabular teams tetralet thiago thykier ticks traffic
transactional transformers tranter tricky truncates tytso unconstrained unlock unpaired unversioned unwinding vagg veeven virginia volunteers yoppy york yyyy
zlatkovic adobe ampere ancestors asserting aumasson authenticated autogen automate awaiting badge badly bailey began boards boxed buglist bypasses carrez
centers certdata chun cjihrig colored comprised conditioned covering daiki davis deciding decl defunct delegates delorie demonstrates denoting descendants
dies diffie dimitris dispatched duty eigenvalues eliminates encounter endless enjoyment equitable evans evenly examining expenses explains explode exploration
ffill fire formula gary germany gimeno gordon gruenbaum guards guillaume haible harness heuristics holiday hommey ident illustrated inability inconsistency
inria instrumentation irrevocably joyee jussi karoonboonyanan keyboard king leaking libasan liblog listlike lives luis mach madler manipulated mars mdash
meanings miloslav mime mipsel monotonic mtime multiples netfilter netmask north notion offloading orient ours parametrization parity parkway pennington perens
periodically phillip phys pinca piping plausible polars powers precomputed preprocess prerelease presumably proceeding promoting psutil raphael reachability
recompile redistributing reentrant relief repeats repos resetting retried river roll room rsquo safest scanf scriptics selectors setters setuid seven severe
shortcuts sidebar smoothing sometime sprintf stars stdatomic steward strptime subdivi superfluous swapped syntactic syntactically tainted targos ties tjaalton
tooltip transient trmac uname unbound underflow unequal unexpectedly unfair unref uploaded uploading userguide varying venv viewed viewing vinay vrfy walker
wasted wolfgang xcode addr addressing affirmer aggressively ahmed aims albrecht altogether alum approval ardo arthur asserts assumptions attacked aurelien
autouse awaited behaved bigonville blah blkid boilerplate borderwidth borins braud bypassed capitalized carriage carsten casted cease ceil centipede cephes
cheng claus clicked codepoints collaborative collisions commercially committing commonwealth concern configures conklin contacted cooper damon dangerous
deliver depcomp derek destruction died dirmngr disambiguate discards dispose dominik draws ebourg energy erase errored estimation evgeny favicon finalization
finalize finalizers fitzsimmons fontaine frees fullname gentoo gotos governance grandegger guillem hanson helping hides honors hostnames idlelib inactive
incorporating infers initiated interactions interpreters jeffrey knob latex leftmost letting libatomic libcurl linalg locking locks longjump love lsof lzma
mailman manipulating manuals maxsize meaningless meson miguel mmap mobile mutating nevertheless nightly nippon nonce nonempty notifies offload operated
outermost ovidiu pathspecs peters phil polygon possibilities preferable prematurely presentation pressing preston priorities promotional provos pursuant
radians ralf raph rebasing receipt recipes refrain reindex relicensing reporter restarts reston restricts resumes reviewing samp saratoga scanned schmidt
sequentially shifting sievers sink snippets sourcecode spam spanish speeds stacking stamp stays stenberg substituting summarizes technological thereafter
threat ticket transparently trap triangular twerner ultra undici unevaluated unimplemented usefulness usenet variation vectorization venture waive workgroups
writeable zack zucchi addressof adilger adjustments ampolo amundson ancestry anybody atanq autogenerated avoidance backports backus balance baseboards bedford
benchmarking bernd bert binutils bityuckiy blvd bridgewater bucket buildd canaries capitalization casts chernov chuguev citrus commitdiff competent complies
confer consequently consteval constinit conveying coretypes coshq coudert cristian crtstuff ctfstd cultural currentness declares dedications defaultmap
dejagnu demetriou demo denied deployment depobj designation destructuring dimensionality directed doctests doctype doxygen dragonfly draheim drain easiest
electron electrotechnical elects elifdef elifndef emults encountering enforceability engin ensemble enters erfq esac exporter expq faults fear federico felipe
fernandez filip filippo fitzsim fixincludes flight follwing fxcoudert gcov gdbm geography gireesh glam glandium glib gnatfind gnatxref gnulinux gofrontend
gratis griggs gthr hgskolan holger hood horizontally hugo ieeelongdouble illuminate illustrate infodrom insist intentional interprocedural invariants isinfq
janik jeremiah jjohnstn joseph junior kendall kimball lasse ldexpq leroy lewis lgammaq libbacktrace libcor libdecnumber libgccjit libgcov libgfortran libiso
libitm liblsan liblzma libmin libobjc libphobos libpim libquadmath libsanitizer libssp libstdcxx libtsan libubsan libvtv llhttp llroundq logq loomis loongarch
lroundq macos memoize mirors modernize monadic mops moscow mptx mulley multinomial multiplicity mutexinoutset namespaced neater nerim newlib nios nonstatic
nvptx oaks officially openacc opinion outfile overrun paid parashift passwords pedwarns pere phantom picked picklable plural polyakov powq practicable
predicates prepends pressed privatization profits promoted prospectively prove punathil pycon pydoc radeon ranking rebased rebuilds recompiling rectangular
reinholdtsen reinterpreting relinquish remotely reorganise repair reporters resampler researchweb retroactively reusing reviewed rework roeckx ronald roundq
rtems russia rvalues sajip salsa sami scroll selectively setgid setjump shipping sincosq sizeof snprintf softwaresupport solved song sounds soversions
spanstream specifyer speculation speculative sprawl squeeze stanford stcarrez stopwords strides strm structural stuck subclassed subsumption subtests summed
superh tatsuhiro territories textconv tgammaq thunk tightened timely todoo toll trained translating truncq tsystem turbolinux tweaks typeclass unambiguous
underneath utilization utilize vectorizer vera versioning victor vxmils walks warrantee watching wavefront wavefronts westby whitelist wise workgroup zelkin
abandons accomplish accomplished accounting accounts acronym actors adjusting advisory amir analogue ansgar ansi anthologies arnaud arrives astrand audio
augment authored beer beth bevenius bolliet borrowed boxes breuer bridge burke bytestring cancelling capital capitalize carbon carlsson carnegie catches
cendio certainly checksum chinese clarifications clash commonjs computers consents contemplated contravention conveyed cook counterparts cyril decipher
decrement deliverable delivery denominator depicted deref descent dimitrios discussing dont dumper editable embodied equivalently exercised facebook feather
flamingo forwarding frantisek fuzzing gale garzik grothoff gunzip gustaebel hannes harden hare harinath herrmann honored impl increments indemnify
ineffectiveness inferring interprets invalidity invented ioanna iojs issuing jack jarno jesse jgarzik jouni jupyter justin keepalive keybindings keygen
keypress kroah kurtz laszlo ledkov ledru lgpl libblkid libmount libwww likeness lillqvist logfire lone lorenzo marti masatake matcher mbox mellon memoryview
metzler mexico migration million miscounted misuse mocks monitoring motivations multiprocessing mutex narrower nations nicolai noah normalizing nulls
offending ohtsu okay opcode openbsd orientation ossman overloads overtly paired para percentiles perfect placeholders placement pointless pooled popup
postmortem preproc prerm presents profiles programmers provenance provisionally pseudocode psidx pulled pummel reaching realm realpath recommends rectangle
redefine redo refine regularization releasing rescission resp restarting rewind rough safari salt samba sandbox schedules schindelin school senkpiel separates
servername severinsson sharma shelley shrinker slight spawns spearman specialization sponsoring squelched stacks statistic steering stray sublicensable
subtest suffixed summarize sumsal surrendered surrenders sysfs textvariable themes thereto threw tight tolerate transmits transmitted trevor tristan
universiteit unported unreadable unstack uploads userland uvwasi varargs waivable warsaw withdraw worst writev xalloc xmlenc xmlmemory zooko zope activating
adapters advantages albeit allen allocates alphanumeric ametzler anderson anti anvin appeal appreciate approximated arrange artur arturo authoritative backlog
bignum bjoern borelli brendan bundles cctest centered chad chop closures commence cond connor consented considerably constantly conv costa crop cropped ctype
customarily customizable cvename daijiro daily danny darren dbus deallocate debhelper delayed denoted destroying diffstat discretion dmitriy docker elliot
employer enel estimators ethan exhaustive exponentially fedora fips flavors florian fooled forking fred frozenset fullest funcname functioning gabor gallium
garnacho gelu ghedini gitignore giuseppe globs gonzalez googlemail growth gustavo havoc headings hiding hoffleit holidays hyphens idempotent imaging
importance inaccurate inappropriate inconsistencies inheriting initiates intercepted intuitive isnan ivanov jira joachim judgment kuchling lachowicz lankhorst
launching licensors lichtenheld linkage lockfile mallach manoj marchini martinez mattia mattis maximal milan millisecond mono mounted movement musical myself
nagy nanosecond networking newest nicholson nits nmav nocera norris octopus oneof onwards ortho parallelize paris pearu penalties perm phases picking plotted
polyval preliminary president primordials printer promisified pronouns pseudonym pybuild quarter queried rahul rand recarray recfunctions reducer reed
repetition reproduction resampling resolutions restricting returncode rickard roberts roderick rosen ruslan santos satisfying scatter scores sebastien secadv
semicolon semicolons sergei seward simplicity sing star stephan strips strlcpy stronger stubs substantially successive surprise templating texas thep thinking
tian timmermans tomas triagers trimming tzdata understandings unpickling unpredictable unquote unwrapping usages userdiff vohr walton weird whatwg wherein
writers xsltutils zeroes zeuthen abruptly accompanies ackermann adequately airlie antonio argsort artificial atol attachment autocompletion automation babel
backoff backtrace bassi batching belanger biederman bitstream blindly bodies bonaccorso booth brentrup brings broadcasted bypassing cardoso carnil catalyst
charlie checkpointed clemens clobbered cloud colorizing commandline computations confidence consolidated constituting contacts contextify contributory
conveniently coroutines crafted dancers danger dassen datasketches datasource datatypes debianization deem defers devel diffusion digests discarding ditto
dividing djpig dlopen docutils dogs downcast drafted drawings drazzib eastern eggs eight elect electronics emails embedders emmanuele emphasis employed
endorsements enhancement entertainment environ exceptional excuse exploit facing farias faulty fileobj fiorina firewall fish folks fran frantzen frontend
fused gamble gathered glvnd graphs groupings hashtable highlightcolor highlighter hong hudson impacted incrementally indefinitely inherently insufficient
irrespective iterative jameswestby jamie jasnell jeanphilippe jloup joerg joshua josselin kent kerola killing kitware klausner klumpp kscanne kuehling kyle
lamont landed lengthy lexicographic libglvnd lowercased lucent maketext malcolm mattias maxim metacpan mimics modulus mohammed nargs nickname nikolai nodeid
novotny occupied ocsp octet onerror openpyxl opera originates origins overlapped pango papers peak perches phillips physically pitt ppid preciese preset
prevailing preview prioritize promisor publishes pyvenv quit rackham raude recoverable recreated recurrence refael refspecs regexes relate renderables
repacking repetitions respected reverting rmtree robin rodriguez rollup roozbeh rvagg savings scannell securely semaphore sept sergey setsid sharpone shrinks
siddall signifies simplification snap sophisticated sosnowski sought sponsor sponsored sponsorship sticky strategic stringified strlen stupid stusta
subscription substance sugar surrender suspended synchronize tarfile tenstral tier tilde tokentype traversable traversing tricked trunk tungsten turtles tyler
ulerich uncompress undesirable uniqueness unparsed unrecoverable uthash utilizing valente variadic wachi wake weber west whitlock willing windowing wong
ximian xmltree xterm yellow zoneinfo abstractions activations addendum adorno advancing ahern analyzed andre andrei ankur annoying approve arne arraylike
assent assorted assure asymmetric attaching attorneys autodetected axelb bell bells berne bjornst blockwise bojer boost bornecrantz broz buckets bumped caplan
categoricals ccid chan chomp chung cjwatson claude cleaner codecov cohen collectors colons communities complained concatenates conceptually conducts
confirmation conjugate contemplating contradict conventional counters crashed croatiann cure deliberately dennis deriving detailing devtools directions
dominic douglas dramatic drives dywan edits eike elem embodiments encapsulate enclose enumerations establishes exceeding expense expert exslt families feeds
flattens forks france freshly frotz fulfill funded fusion gender graceful grayscale greedy guesses gutierrez haehnle hansen helped henstridge hideki
homogeneous identifiable inbox incrementing inexpensive inter interpreting introspect inverted isaac jared javier jesus johnsen johnstad joss jung labeling
laid langasek lecture leverage linguistic listens localename looijaard loosen lopez ludwig lysator majer mandriva mangled marcin mathematically mathieu mawk
mentions messaging metaclasses meter meyer mistaken mllib multibyte multiclass multiindex mutation nanops negate netloc netrc neutral nftables notifications
noting nouveau nylander obtains ourselves overlaps packagers parametrize parker partitioner pedersen perldoc permissively persists perspective pixmap poll
popen pops powershell powertech pprint presently privately privilege proceeds promisify prompting pthread quantizes randomness ranks raster rebuilding recast
recompilation recordings recurses reimplementation reindexed reinecke reiss relax remedy repeatable resample resampled residuals resized restoring revealed
reversing revs riverland robinson romain route rsakey rtol ruiz saxon schulhof scoping secs selling sensitivity serge sergio serving shortened shortest shutil
simo simonov skew skolelinux smooth specifics spinner spreadsheet stanislav steensrud streamline styled sublicenseable sublicensed submission subnormal
subquery subscribed subsets symlinked symmetry synonymous sysctl tester thenable timeframe traced triplet troup tunnel ufuncs uint unescape unflag uniques
unpivot untouched vadim vandermonde vendored vidal vitaly warrants waste wittawat worktrees xinclude xnox yamwong yann accompanied administers administration
advisable aggressive alfredo almesberger alon alphabetize amending andersen andrzej announce answers appearing ares arranged asciidoctor assimilated
asymptotically attila authorizes avahi awaits awesome backpressure beforehand bellovin belmonte berets berg binascii binder blundell books borowski boxstarter
builders bullseye camellia capacity categorized cats cctx cernekee cesar cflags chang chart checkbutton choreographic cinematographic cinematography
circumstance circus claudio clint coccinelle coercing collaboration connectivity conservative continuations contraction corey costly cpuset crypt customary
dafydd damyan daniele danielle danielnylander datakonsult debugged declaim decremented deduplicate deltas demarcate derives derogatory designer devised
disambiguation disclosed disks dispatching distort distortion doctool doesn dominus dramatico ebiederm editions einsum election emulates encapsulation
encyclopedias engineer engraving erick euclidean everybody expiration fakeroot fell fellows figsize finalizes fixation fixations flagged fleck flock flows
folds folklore forrest fridrich friedl gareth gautam generics german getaddrinfo getline gilles gilli gitattributes goronzy gpgconf gray grigori grows guided
gusarov hamano hanging happily heen hertzog httpbin hunter hwclock identities ijaz incidentally industries infile injected inlined inversion iteratively ivar
jaeckel jansen jbelmonte jberets jdassen joakim johnsonm josip julia julio junio kerolasa keylog khayat kostas lambdas legendecas lexicon libidn libuuid
lithography localns loggers looping losslessly lutomirski marcos mateusz matthieu maurice meeting meissner memo mena merino mesg mine ming minified mkdtemp
moderation monsalve moshe musicians musl mutilate mutilation navin nazar needless needlessly newman nieder nished nullish nyquist obey observer otte
outputting painting pamphlet panel papadimas pape patel paulo pavlov paying payment perfectly performer pertinent peslyak petrov phonogram photographic
photography picture plexus pooling porters positioned pournader prejudicial proof pulls quotation quotient raja react readdir readily rebroadcast recitations
recognizably rect reczey redirecting reductions refusing reindexing relations renegotiation reopen replicate representative reshaping residual retaining rmdir
robustness rodin rome rose rotate rsalz schroeder schwarz schwern screenplay scrypt sculpture sdist sermon served serverlisten shaped sheikh shortly shutting
siewior silva simultaneous singers skokan smudge souflis spdx spinbox stateless stef stichele stringification subelements suffice svalente swaps synching
tagoh takuro tcsh tfheen thefourtheye thinks tidy titled titlepage tollef topography topology touches toward tweaking twinsun twitter typography unaware
unfinished unnamed unshift unsure vavilov vipw visualize walsh wanting weighting wget whoops wins winter wireless xdeg xmission xsltlocale ydeg yosuke
abbreviating abstracts abuse addaleax adjusts albert alexis altlinux anatoli anholt appaiah appro approximates arboleda arrowood assemble asset associative
asterisk auditing autocomplete averaged awaitable balancing banner barf baumann bench benji benno berrange berry bigon bisecting bitmask blandford blowfish
bluca bnoordhuis boccassi bogusz bookkeeping bookworm borden browsing broyer brulebois bueso buster cancels carolina cascade characteristics checkpointing
chin christos cite cites clamp clarke clocks coalesce coalescing codehaus collin compromise coordination corners corrects courier courtesy crichton cuda
dahlin danek daney darehanl dataflow davide davidlohr deactivate deallocated debuglog decent defaulted definitely delegated destroys diag diagonals dialogs
didier dieter dima dirs distributable documentations donor dottedmag downgrade dsig duesseldorf durations eagle earliest east eclipse encapsulated encrypting
enforces enforcing ensurepip enveloped epsilon erroneously establishing euro evanlucas examined fabrice fenio fflush figures finalized fink fiona firing
flowing foot forcefully forest freetype freeware fsij fsync futures fuzzy gardner garrett gerrit gitdir glext globalns glxext gniibe gpgscm graduate granting
grey gypfiles haas hajime hallyn hamel harband henrich henrique hexdump hindsgaul hitting homebrew hosny hundred hurd immediates impacts implementers
implication importer improperly inconvenient indenting indicators informatik initialised innermost integrations interacts interruption iptables jimenez jumps
justus kellner keybinding keying khaled khoem kibi kohei konstantinos krems kristian kure kurem laposte leon lexically libpng lior loopback lossless macosx
mainproc manipulates marcelo marko mathew mazurs mbroz mechanical mercurial mersenne micah michigan mimetypes misplaced mkfs moritz mouette msgpack mueller
multicast nasty ncurses ndash negotiate nest nikhil noisy norbu numarray obligated obscure openismus operational opset orthogonal otto overloading palette
participation pcre piarres pkst poor porter posted postject praveen principally processstdout prog progs promised purge pybench pytables quadratic quic races
ranjit recognition recompute redefinition redistributors reformat reftable reid reinstated releasers relocated reordered rerun resemble reserve resilient
respecting responds restarted resumed resuming resumption retired reverts revoke rhash ritter roth ruleset runtest russian sakthipriyan salazar sayle scans
selective sensing serializers seriously serpent shah simplifies skill skiprows slackware smurf snake social sockprox soeren sokhem solar spin spline
stackoverflow stewart stick stochastic stone storable subok subpattern sunjae supersede swallow synchronized syntaxes sysutils tangent tanner targetpath
taskset techniques thorsen tooltips topological translator trash trent triaging tricks truly tshewang twofish ugly unauthorized underlined unfortunate uniq
unmark unmasked unpickled unsubscribe unwrapped urlichs usecols vadla vairamani validly vanilla varint watermark weeks wesley whistles wichert wintypes xlib
yamane youngman yutaka zach zefram zheng zoulas abbott accelerated adduser admits ahem aiet aietkolkhi akkerman alba alban allan alvarez amacapital amazon
anchored apparent archived arguably ariadne astur astype audrey authenticity ayuso baryshkov bashu basil baurthefirst baurzhan behaving berserker bique birth
blanc blkdev bluehost bogorodskiy borders bortzmeyer boszormenyi bothamy bradford buch buga burjan buus buvoshetes carlo cased cautious ccache chary
chengzhong chet chrt chunking claire classmethods clisp cloneable cloudpickle cmac cmaloney cobaco cocoa colcrt collax collectively colrm compilations
complaints completer continuously convergence cooperative corentin corentincj cornelis countdown cumsum daemons dataframes dauren dbaryshkov dctx decoders
deduced deelerious defective defend deficient definitive deflake delays derivation descend designates destinations dfranganillo dialects dictates
differentiated directing dirson disclosure dispatcher dispensa distinguishes distros ditrans dividend doctools dollar dominz drafter drained drew dtrace
dugsong dumped dying eagerly eazel eder elie encrypts engel enqueue entrypoint environmental eremin esko experiment expires exploited expresses faithfully
fastpath fedoraproject felli feng fernando fillna finders fingerprints flannery flood fopen forgotten formally forum fqdn franganillo frankie fread friedrich
frolic frysinger fulfilling gains galas galatoulas garcia gede ghaderi gibson gisle glue gmplib gnulib goodbye gordoni gostdsa groff grok gruenbacher guljas
gurame gurban gwijayas hacker haiku hardlinks hartman hashed hashmap health henrik hereinafter heterogeneous hidayanto histogrammed hive hleb hocevar
hoehrmann hoffman hofstaedtler holland holzt hongzhi hornkvist hosting howto htaira humans hyperbolic ibarra icons idiomatic idna ignorable iksaif imanuel
indirection inequality infos infringements initialisation initiating insogna installers intends introductory ionice ipvvis irlam isaacs isotonic italian
itemsize jaak jacobo janssen jborden jiro jitted joyent jtarrio juaristi judicial kaiser kalic katz kaunas keating kebil kees kern khattak khmeros khoemsokhem
knut knuty kojima kolkhi korea kurtosis latze launchpad leko lfpor libfdisk libsmartcols licenced linbit listened liyanage loadable locality localtime
logindefs lool loopdev lore loses lovergine luiz lujz lundh luscon luto lyons macintosh madsen magically maildir makoto malditoastur mallikarjuna
mallikarjunasj maloney mamoune manufacturer marcel marchenko marga margaritis marineau markos marques marsonya marvin massive matheus mbacke mbsalign mcookie
measuring melchior meyering mgorny middleware minghua minier mistry mkswap mluscon modeled modsoftsys morgner mouhamadou mozhet muftakhidinov multithreaded
murdock myftiu nakhare narrowed nayenko negation neira neolocation nett neumann nielsen nocrew nogil nopython norvell nowcomputing nrows nsenter nugroho
numexpr objections observability offline okhayat ooprala openlabs oprala orange ordinals ossama owning pacific paging pane papamichelakis papirovski parlin
participants peled perforce petri petrisor piatruk pickler pictures pipermail pironti plaintext poly polyadd polydiv polymul portella posnjak postinst pravi
prefixing preimage preloaded prep priv probabilities probe procutils protects provisional pthell purdue pyproject pythonx qcai qian quantizers radiobutton
ramakrishnan randutils rapidly rcond rearrange rebinding reconstructed redact redis redwood reese refnames reliance remembers remind renesas renice replayed
replaying replicated requireid resellers resenje reshaped reside resver rewrites rick roaming robots rooted routed rowan rubanau rudolfs ruehsen russ sadie
sahana sahran sampada sampadanakhare saner sarsenov saurav sburke schedutils schneider schuldei secondarily segmentation selections sendemail sendmail seppo
setitem setpwnam shaleh shields shifts shot shrunk shubin silly silverwind sine sistina solves solving soname sortorder specialised spoofing squeezed
stabilize staff stdarg steiner stemmer streebog streeter strength stringifying student study subarray subdir subplots subtracting superblocks superseded
supplies surgut suspend sveinki sveinn swallowed swift synonyms syscalls tagger taira tarrio temple tend tewekgeli textarea theoreticalchaos thereby thirty
timedeltas timeutils tomos trac tran transmeta triage trip tsujikawa ttymsg ttyutils tukaani turkish twelve twister uchar ujjwal ulimit uncomment unencrypted
unicus unintentional unintentionally unmapped unprocessed unreferenced untz upsampling urllib vahid vanja videos vikram vincentvikram watchdog weakref whereis
wijaya workbook xref xsltexports yarn yrvin zablotny zacarias zeeshan zeeshanak zeha zimmermann abell accessibility adconrad admission adrien affero ages
akamai allbery alters amiga angband announced anticipate apis artifact asciidoc ashie assistance atomically attackers attrib autonomous autosummary awkward
band barfed barr batched beattie beep bernhard binmode binomial bitmaps blackman blink borrow borrows boxplot bravo bringing broad broadcastable bubble
bufsize bzip cacert calvin campbell canonicalized capsule carlosg catalogs cdbs ceiling certification chaplin chardet checkpoints chia chicago chip citation
cleans clickable codehelp colour commitment communicating competing complements concurrency confirmed conftests connectable conrad contest contextmanager
contracted contradiction converge conversely convolution coon coredump cork craft crlf cube cumbersome cyren cyrus daeyeon danielleadams danjou darshan
dayfirst dconf dean debconf decompressing decoration decreases decrementing decrypting defensive denys deploy deque diagnosing differentiating differentiation
differing disambiguating disappear disclaiming discrepancy distances diverges dnlup drung dtor dudman dunder durigan dylan ekstrand elevate elevated
ellinghouse emily emphasize emulating england enjoy enumerated equations escalation estrada evgeniy evolve excellent exemplary exploits exploring externalized
extreme face factorize fahnestock faked favoring favour fftshift fillchar fiorinaf firm flattening formulation fortunately frameworks franziska franzke
freedoms freelist freqs fubar functionalities functionally fundamentally fuzzer gabriele gate gauss gbarr generalization generous geng geometric ghaering glen
glitch glyphs gmane golovan gonzaga gpgsm grammars grammatical greeting grin halls hamann handed hardcode harm harmless harmony heath heiko hermeval hermval
hinkelmann hist histories hoyer httplib iana icutrim idiom ilia imag imitate importantly imurdock inaccessible inactivity indic informs initializations
initiation interop interpolating interspersed intp inversely ipaddress irreversible isfinite isinf iter jeffery jeske jessie jiawen joel jover jseward
junction justified kakilik katholieke kazuki keydown keylen keystore kilobyte klaralvdalens knew knobs konqueror kqueue lagval larson lauri leakage legitimate
lemire leuven levien levitt libev libm libpython libssl lifespan linenumber linesep lingl livermore lldb locating logits looped loosened lovelace lucian lupus
magical maintainability maria marquess masahiko materializing matsumoto matthijs maximize mendez meng michalkiewicz mika milad mins misconfiguration mktemp
molaro mora motion mounir mpitt narod nayan nbytes negatively nelson netcat niklas nishimura nison nizipli nomask nominal noncommercially nonsensical
notifying nsswitch nuernberg olaf olivier onovy openjdk optarg optimizes optimizing optparse organized oriented originated orton ospite ostroukhov otaylor
outbuf ouyang padx pady panedwindow paren pareto passive pasted patching pauli pays peek peeters penners perror persisted piman polysub pooja popped possesses
postfix powell pradeep precompute predecessor processstderr processstdin pserver pseudorandom purcell purposefully pyshell pyxdg quartic quux rabbit racy
ragel randal randomized raven reciprocal redefined redesign reflecting refreshed regressed relicense relink replies republic resolvers resort responding
restructuring rethrow retval reviews rewrote richardlau rietveld ring rmin robbins rogers rollover roundtrip rustcorp ruyadorno sanchez sato saturday schaefer
schlueter schulz scorer scrivano scrolling shelf shims shin shopov shorthands shuts siemens signify simdutf simen sloppy smueller snowball sortedness sparsify
spider sqlite squashed srivasta statuses stem stevenj stimulate stress stride stringent studied subgraphs subjects sublist subprojects subroutines substantive
successively suffer sunsite superclasses surname surprises susceptible symref takuji talks tampering tanh tarinfo teddy tentative ternary textbook thijs
thoroughly threatened thumb tierney tighter timeline timmy tire torn toronto transfers trapped traverses trunc turkmen turtleshape typechecker typeset udevd
unaligned unavoidable unbalanced unchecked uncommitted undone unhashable unpipe unprivileged unrefed unstacked unsuccessful userid usernames valve varkw vast
versioninfo violations voting waclawek weather webserver weekdays workloads wreschnig xscrollcommand yadong yagiz yash yearfirst yorkie yoyodyne yuval
zaitseff zbigniew zuza abcde accident accumulations activebackground addison administrators adoption adopts advertisement advise advisories agaida agnostic
alastair alec aleksei alfred alibaba alifieraki allegation alleviate alternates amplification analogously andhra announces appendices approvals approving
archival arcor arctwo argiolas argname argtypes arises arkadiusz athena atheros atomics autodetect autoload automatrix autotools avery azure barbieri baruch
beerware bekkhus benedikt bhalerao bidi billeter bioreason bisection bjornson blake bless bohdan bonzini boss botched bounding brandon bubbles budget bues
buesch bull bullet burchardt cabrita caleb calibrate campailla cascading categorize cathedral cedar century cespedes cessation cgit changwoo chroot cial cited
citgm claes clashes clauss clever cobo coexist collapsed collation colorful combinators commer commutative companies compaq comparator compelled comprise
compton concluding conclusions conditionals configparser confirming consoleerrordata consumable contrived cool copyedit cosmetic costello counterclockwise
cozybit cron crude curses dalke dashed datatracker davem davy dcommit ddstreet deallocation deallocator debugserver deferring delegation deliberate demos deng
deployed descr deskey devsnek diagram dickenson didrocks directs dirk disagreement disconnecting dismiss divisible divmod dmity donald donenfeld doubling
drains dramatically dselect dshaw dtoa dubroca dumping duque editorial egenix eigenvalue eliminated elio embeds emmel encourages enterprise enumerating errata
evvers excerpt excinfo exodist exploded exportable exposure extensionless farbing fastmail fchmod fergal ffffff filelike fixups flamingice flex flips fnmatch
foad fputs freyther friesen fsateler fuller funcs fwrite gafton gaida gallagher gathering gengjiawen geographical gert getattr ghostwriter gini gitconfig
globbing googlemock gottner granlund granum gridded guessing guest guilherme gundersen gunnarhj gupta gypi gzipped haitzler hamming hardlink harmful hatch
helland hess hijacking hitesh hjalmarsson hotspot house htest hubert huffman hughsie hyper imain impacting importers inaccuracies inadequate incapable indents
induce infinities innovation insofar instant instaweb intelligently intensive interfering interpretive inverts ipython irregular isna isolates iwakd iwamatsu
jabberwocky jigsaw jimmy jithil jklm jmacd joao joshtriplett josue jpaint juanarbol jwollrath kaber kamp kang kara karunakar keychain keyserver khaidi kicked
kiszka knoll krah krasnyansky kravchenko kropp kubo kuck kuhn labelled lachance ladha lama lands latitude launcher launches lawyers lchown lemberg lenient
lenny leonardo leonerd leung levin levitsky lexsort libassuan libdes libenzi liberal libexpat libmpdec libsystemd linaro linefeed listbox livia llvmtest
localisation localizing longitude loosely lord lrodriguez lstat luisca lukka mack maddock malinen mandy marie mary masashi mass matlab matumoto maxpower maya
mealha meantime measurements meck medeiros meeks meetings menlo menus michiel midpoint miettinen migrating minwoo misspelled mmarchini mocked moderate
modernized mojam montanaro montecelo montel moore mounts multiplexer mutexes nabijaczleweli nalin nasm nation ndtype neves nguyen nikita nikolay
nondeterministic nongnu nonlocal nontrivial norbert normalised noun nspr numerator offboarding ofrobots omar omissions omits opacity opener openwall opted
optind orangesquash originate oudkerk outbound padala pain painter pali palo parens patchlevel peers peng periodic permitting perrier petm petriuc pickleable
pinentry piter piterpunk pittsburgh pixbuf played plover ployees pluggable polling pose poul pradesh prasad precede precompile pressure presumed pretrained
primordial prince prof profitbricks prokop prompted pronoun proportion proposals prototypically prudent pthreads punk pypug pythonware queasysnail quictls
quirks quotechar ratios ravel rcmd realistic rebecca recipe reconfigure redundancy refloat reflogs regarded regenerated rejecting relates relationships
releaser relevance remy reputations restructure restructured retention reuses revamped rivest rmax roadmap roche rommel rongjian routing rudolph rushing rusin
sabrina sahani sampson sanitize sassu sateler schaal schaik schlittermann schulenberg scikit scrolled scsi seekable seiler sergiodj settled severed sgml
sgolovan shaun siblings sideband siduction sigxcpu simplejson simplistic simpson sipsolutions sits sizer skeggs skewed slider slowest slowloris slurp slyon
smartos sopwith sorce sourced sourmilk south southern sparsely species splitter stacklevel staged stalled stelian stock story strauss strcmp streetman subnet
subparts subscripts substr suits supplementary suppliers suppression susant swallowing swapping symas sympatico synch syslogmodule szakmeister tadavis tagname
tang taxes tear telnet testcase themaw theoretical theoretically thor thousand threadsafe tickets timerify timespec timj tinfo toby toiwoton tokenization
tolerated tone topi traps traversed truecolor tset tspan tsvettsikh tuffmail tutorials tweedie typings udev udevadm unacceptable unambiguously unbuffered
uncle uncombined undeclared unicodeobject unitary univariate unlocked unofficial unprefixed unregistered unsquared unstructured upfront upsample utterly
vasiliy vereshchagin vernon video viktor visitor visually vogt vollmer voxnest vtable wasteful watchers webassembly webkit weekly wegner weijia weiser
wellnhofer wholly wilhelm winship winsound wishing wollrath wrongs xfail yarrow yoshiki youfu yuriy zbyszek zeroed zhangyoufu zipped zoom aapo abbr abhishek
abide accumulates accurately achieving additive adhering admit admonition adopt advances aggarwal aggfunc ahmad alexei alioth allclose allocs almeida altering
alternating alto amax amend amin ampersand amplitude analyzes animals animations anoncvs answered answering applicability arceri archiving argmax argmin arity
armand armstrong arnold arrows arroyo arry asof asserted assess atlow audit australia authorities autoselection avro backs baker balling balyasnyy batman beck
behaviours belen berger berlin bibliography bjarmason blessed blocksize bmasia boosted boosting bootstrapped born borrero bourne boyan bpnumber bradh branden
branderhorst broadcom bubulle bultje bumiller bundling bunton bynens caffee cain calc calculus calle calloc camel canceling cand caps careless castro cencora
centraliens centralize centricular certifi chacha chainable champion checksums chengwei chimelis chittora choked chronological chronox circuit circumvent citi
cizek claessens clarifies classpath clegg clientattrib clipped codebytere codeweavers colorize colours comfortable compresses compresslevel compromised
compsize condense condensed cone confusingly consecutively construe containment coombs coordinator corbin correcting correlations cosmin county courteous
crawford crucial ctime currency cyrillic darin dataview datum declaratory decomposed decreased decrements decrypts deduplication defeats defendant definite
delaying delegating delimit dell demonstrated deployments deserializes deserializing deshmukh designs desire deutsch dickinson diegog difficulty dims ding
director disallows disappeared disconnection discusses disputes diverged doctrines doubles downsample dport drafts draining drake dwheeler earl earnings ecdh
echevarria effected eglextchromium ehrlicher eigenvectors ellis emanuel emulators encoders enforcement enumerates ephemeral erik esser ethical etnaviv
eventtarget excepting exclamation executabiity exercises exherbo exotic expiry exploding explored explorer exposition expressible extensible extrapolate
fackler factual fallocate fchown fernandn fgets fifi filehandles filemode fileno flash florin focused foldable fomichev fonseca forgive formalize francis
freenet frogmouth frost fsspec fstab ftruncate furukawa gabrielschulhof gaining gaussians getcwd ghee gibfahn gilfi giovanni girlin gitfile gitter glcorearb
glenn glxclient glxcmds glxcurrent gmeiner gnomovision gobble googlegroups graf grafts grapheme grazvydas ground grpc gsapountzis gustavson habacker hackers
hainaut haitsma harakash hardened hards hashlib hashseed hassaan haxx hayes heated hebrew hein helios hermadd hermdiv hermeadd hermediv hermemul hermemulx
hermepow hermesub hermmul hermmulx hermpow hermsub herrero hierarchies highlandsun hill hinting historic hkdf honours houdoin houston hsieh httpd huawei hurt
ignotas inbuf inches inconsistently increasingly independence indiana indiscriminately influence infradead infs instability installable instants
insufficiently integrates interference intermediary interrupts intersect iran iryoku isexec isup italo itemsets jaap jain jake jellinghaus jelmer jeronimo
jesper jnweiger johnny jpeglib juergen junichi junit justification kaminskiy karlsruhe kasanen keane keen keenan kelvin kenny kernellabs keyvanzadeh kilobytes
kjartan kohta kreen kukkonen kunal kylheku laforge lagadd lagdiv lagmul lagmulx lagpow lagsub landaeta lanedo langley laumann lbnd lcamtuf legibly lehmann
leidekker lekensteyn lend levitte libxmlsec lift literature locates lookahead loophole loring lttng ludo macieira mackall magnus maraas maraeo marekm masia
materialize matthews maxdepth mechanic menubutton merchantable mergesort mergy meshgrid metacharacters metavar metcalf meurer mhdawson microbatch mikeal
minimally mirkin misconfigured misformatted mishandle misinterpreted misses misused mkstemp mlschroe mngr monkeypatch monteiro morozov morten moss motivation
msecs msvc msysgit mtrace multipage multiplicative murphy mutates mutations mutt myers myfile nanmean nans narang navarro navigator nearby netlink nhaehnle
nieminen nieuwenhuizen night nine nistpubs noll nomadium nomination noncommercial noticeable nouns nowhere nullability nvlpubs observable obstruct occasions
olvaffe oneline onward ooms opcodes opendir openjsf openpgp opinionated orasanu ordinarily orig orphaned otrishko outliers outputted overflowing oviedo
packrender packsingle pads palmieri palus panda panic parameterize parenthesized parrotting participate participating pasha passage passages passphrases
pasting pauses pellegrini penguin permutation petersen philosophical phrasing picks pinning pitfall pitoiset pixar pixelstore pluggy pluginorder pnpm polish
political polyder polyfit polyint ponnan popups portuguese positionally possessive postprocess practically prebuilt precisions precomputing preexisting
prerouting presenting pretended prevail principles privileged probable processenv procps prod profilers progname progresses progression promotes propagates
protective pulling purchase qmax qmin quantifier quantities quartiles quinlan quota radio rangelrooij ranked reality realize reassign recognizing reconnect
recovered recursed reding referrer registries reimplement reloading remi reminder removable renderings renderpix rene renegotiate reorganize reorganized
repartition rephrase replicating repost reraise resident resurrected retailers retitle retrievable reverses revising richardson rico rigorous rimraf robclark
rollback ronacher ronkorving router routes rrule rsacert ruff runnable saper sapountzis sarah sash schake scheidegger schwartz scream seeding seemingly
selinux servicing setenv setlocale shallowly sharex sharey sheets shield shobhit shubham signalling significand signum simplifications sindholt singlepix siro
slab slaves smarter smit sock sony soup spectrum spit spot staticmethod stellard stemming stevens stmt stoebich storsjo stoth strcasestr strdup streamnovation
strictness stringbytes strto stschake subkeys subpackages subresource subtrees subunit summit supplemented suppressing surrogates suspect suzuki synthesize
tahkola tailor telecom tempting tencent terminator testsetup tgraf theirs thenables thibault thkukuk thompson thoyts throttle thwart tianjia tiers till tmux
toggled tokenizers tommi topmost torrey toscano toshiya toth touched transitive transpilation triager triangle tril trio trivikram troin truta tstellar
tuesday turckheim turney tweet twisted twoaday typevars udtf uncached undump unexec unizar unmap unparsable unregisters unreleased uptime usemask utimes
uuidgen vadimgirlin vague vandyck vcizek vendors venema verbum vertarr vila vimdiff vitezslav volumes voluminous vorlon vrije vsnapshot vulkan wakkerma warner
wasting watermelon webstream weibull weigert weinberg weiss welcomed welte wendel whereby whilst whitelisting whitwell widest wietse wilcox wild williamson
wollny workspace wyszynski xxxx xyzzy yiyang yohhoy yongsheng yumkam yuri yuta zabaluev zalewski zaynar zhasha abigail abilleira abstracted accumulating
achieves adapting adaptive adelmann adheres adri advises aggregator agra airlied ajuba akhil alarming albanowski alberto alerts alexandros aligning alphabets
alpine alpn alternation altsvc ambiguities analyse andi andras andrej angry animate anto antsmartian anytime apostolou appropriateness aqua arai arbitary
archaeopteryx argnames arman arrive arriving artificially asarray ashish ashkenas asrecarray assembling assessment assurances asterisks atexit atkinson atob
attributions audience automagically avdyk awakened azard babelouest babu bahner balanced banana baquero barboza battery bbox bcoe beam bearer becker begun
belder benfinney bengl benoit berkom bethany betts beyer bickle bieber bismarck blocklist bloodgate bluesky bodywrapper boom bootstrapper brabec brace brack
brady brainstorming branching breese brevity brinkmann budeanu bugtracker burton buyer byagowi cacher canada cancelation cann cape carp carroll challenges
chances charges charter chebadd chebdiv chebmul chebmulx chebpow chebsub chebval choke chopped chrisdickinson christensen christophe chroboczek chromedevtools
ciphertext classify cleartext clenshaw clobber closefd cmdline coakley cobra cocci codeowners coercible cogrouped cole collapsing columnar complains
compliment comprehension computational computationally concision conclude conclusion cons consolelogdata contentinfo contextified continental continually
contradicts controversy cookbook cookiejar corelist corpus correlated cpus creat crosses currentmodule customevent customizations customlist cuts
cvsexportcommit daemonized danbev danilo darley datelike davies deadline debiang debounce debpython deckers declarative decorating defaultdict deferreds
degenerate deinit delgass delphi demonstration demoted depths descended detrimental developments deviations devin devname diagnosis diaz directors dirent
dirichlet dirtbike disagree disappears disconnects disposable distclean docopen documentwrapper donal donated dozen dragging droute drysdale duckdb duffin
dukhovni duplicating ebrahim ecdsa echoing ecmascript eduard effectiveness elaborate elems embeddings emitters empirically emptied endorsed enqueued
enshrining ensuing entangle entanglements enterprises epoll estimating eventual everett everyday evicted ewing examination excerpts excessively exempt
experiments explodes explore exportselection exprs extensively extname facilitates facto facts falk fancier fandrich favorite fclose feasible ffff fftn
filetype fillcolor finney fires firstly flake flameeyes flarna fleming flores fmax fmin foley fontenelle forfeit forkserver formulating freijeiro friedhoff
frozensets fruit fthash fujita fujitsu gabel ganesh gavant genie genindex genshi geoff georgios getnameinfo gifford gigabytes gilbert gireeshpunathil gitster
glance gmtime gnumonks gold golden gorse gouget grabbing grade graveley gravereaux greek gregorian grepped gscrivano gstreamer gtktextbtree gtktextchild
gtktextsegment gtktexttag guideline gutmann guybedford haejoon halt hamburg handing hangs hangul hanning hardwired harmonize harris hartmans harvard hasher
hashref haskell hausmann hawk hazel headerlink heapdump hedayaty heesch heinlein henke hergert hernandez herzberg hexdigits hinosawa hiroto hiroyuki
histograms hole holmgren honour horribly hosken houdt hrtime hstack httpgetoptions hurts hush huynh hybrids hyndman hypertext hypofuzz icloud iloc imperative
importation imran inclusions incorporation indivisible inetd infix influences informatics inodes insane instantiates interceptor interchangeably intermittent
interoperate interpolations intuitively invalidated invalidates inverting ioctl irfft isin isinstance issuecomment italy jagdish jansson jargon jenna jeong
jetmore joern joernchen joeyh johnpol jonsson jpeg jsdoc jslint juliusz jumped jure jvelezpo jyrinki kamat kanwathirtha karsten keio kennedy keyrings khatti
kick kleinert koblas koenig kogai koskinen koster kozyatinskiy kraai krishnan kurdyukov kwilliams labelling lafayette lameter lastly laverdet lazr lckpwdf
ldquo legadd legalese legdiv legmul legmulx legpow legsub legval lehenbauer leidert leif leniency levert levy lexicons lexing lexsorted libdrm libltdl libnet
libnode libunistring lichtmaier linkedlist linkify liran liso listings llama loadtxt localname locators locke locker logariphm logjam logout longformer
longstanding lorenz lotus lsquo ltdl luvaton madden magallon maggi mainline makevars mangle mantra marchesin marchi marczak margins market marketing marsh
matej materialized mattes mavroyanopoulos maxima mcollina meaningfully menon merlin mestery mgilbert mickey minification minimizing mining misbehaving
misspellings mithun mmagallo moazin moeller mohamed monic monitored moon morris morrison mosberger motivated muck multiauthor multipath multiplier
multivariate naba nader nanpercentile nardelli nardis navigate negatives neglected negotiated netflix newcomers nitzan nntp nodelist nohighlight noloader
nominations nonstandard northern notebooks notranslate novel numify oasis objectname objs observing obstack occasional ogrid oleg olszta ondrejicka openldap
opensslconf optimisation oran organize orlando orlenko orwant othername outlive outlook overridable overwhelm overwrote oxan packer parseable participates
pascual pathak pawar pawel payloads perlfunc perlguts perlio perlreapi perls permalink permutations perpetuity personality petasis phillipj piecewise
pipelined pktdef planner plessy poczta poisson polar polished polkit polymorphic polymulx polypow populating porcelains positioning postimage pranshu
prdownloads prec precludes precompilation preconditions preferring prefetch prefilter prefilters preul primes privkey proactively probes processexecpath
processexitcode profit programme progressive prolog promptly prose protonmail protoype proulx proxied psarrst psaux psblues pser pserror psfixed psfont psft
psglue pshints psintrp psread psstack pstypes pubkey publicsuffix pulse pulsing purvis putc pylock pyshared pythonic pytorch pyversions quan quantification
quantify quantitative radiobuttons radix rafal randomization raspberry rdquo readiness reboot recalculating reclaimed recombine recombining recommending
recompress reconcile recovering recv refactors refreshes refreshing regcomp regen regexec regularizer reintroduce reitz relational relaxed relinking reopened
repetitive reprojected republish reqs requestsocket reraised rerunning resembles resizemode responseenddata responsesocket retire retryable reversion
rewheeling rfft rfftn rizzolo robot roelofs rolled rottmann rpcsvc rsapub rtinstall rtremove rtupdate runners ruud ryzokuken salisbury sande saturation
scalable scenes schaaf schemenauer schonning scoring scriptlet scrollbars scrub searchable searchbox searchsorted searchtools sebastiaan secrecy seeds sekido
selectable selectbackground selectforeground separable sepi serdes seth setsockopt settable setups shareable sharedlib shuffled significance sikelianos sinc
sitting sizzle skel skewness slim slotted smarden snapshotted snider sockaddr socketunref solicit somebody sonatype sourceful sourcemaps specificity sped
speedups spellings sphinxsidebar spkac splines spring springle squeezing ssection stalling staplin stashed staticmethods stdbool stewards stojanovic stowers
strang strcpy strerror strl strlcat strnlen strs structuring stufft stylers subcmd subcontext subjectively sublists subplot subproject subscriber subscripted
subsequence subsidiary subst subtracted suited sullivan sums sunnyvale surrogateescaped swecha systemctl szymon taggart tagging taiwan tall tandy taymans
tclsh tedious telegraphics tels telugu templ tense tensordot tenth terribly testname teukolsky textually tformat theanarkh theta thorough thorpe tightening
timeit timshel timsort tiscali toftdal tokenstring tondering toolan towns tradename transpiler trevisan trial triplets triu tucker tunneling tuomas tween
typecode typofix uncork undeprecated unhelpful uninstallability uninstalled unist unloaded unmaintained unmanageable unpacker unpickle unpleasant unquoting
unscaled unsetting unsorted upcast upstreams userinfo uttam uziely vainikainen vals valued variability vastly vcpkg verbal vieira vignaud ville viper
virtually vsemozhetbyt vstack vuln wade wagon wallbraker wallclock watches water waters wayne weakly wheezy whence whisper wilk willingness wintab wireshark
wirzenius woltman workerterminate wyatt xalan xargs xhistogram xmlto xmltoman xsubpp xuguang yank yoshiya yppasswd yuan zappa zdeg zebra zeke zeroth zippel
zoltan abbreviate abdirahim abis abrupt accent accidents accumulation acknowledged acknowledgments acpkm activates activeforeground adaptors adapts addepalli
admcd administrative adopting afalg afterward agarwal agencies ahmat akin akshay alcock alcove alliance alligator allocators amaya ambassadors amit amongst
amut analytics ander andrewsh andreys ankit ansasaki anty apodization approx approxidate appveyor aptitude aqrln aravinth arbur arcfour argon ariel arlott
aron arranges asad ashi ashley asia asosedkin asprintf assists asym atkplug atkprivate atkrange atksocket atktablecell atkversion atkwindow atlas atspi
attilamolnar attn audited audreyt augie aulery autoattribute autocrlf autodetection autolock autoreconf avinash awox axelsson ayase babyl backes backgrounded
backups badblocks bakke bang banned bapt baptiste bardenheuer barisione baron bartlett basch basealt batmobile batrla bayes bcde beauzee belardi bellgrim
beneath benh benhabiles benhoyt benson bergsten bgardner bidoul bindresvport binfmt birthtime bitarray bjacke blackhole blaise blanket blessing blinding bmeck
boldface bottomley boucher boulton boyd bradmark bram bras brazilian brett brew brik broadcastchannel brothers brummer bryce btoa bubbled buck buckheister
buelens bugreport bundesdruckerei burgmeier burrows bush buss bwiedemann bzlib cachedir cairo caldwell calendars callsite calvinmetcalf cancelable
canonicalization capitals caribou carlier carolin carter casas catanzaro ccapi cclauss ccodearchive cdata cdot cdrom centre certtool cgallek chainlint chair
characterized charsets chattr chatty chelu chemi chew chiark chikunov china choi chopping chornoivan christiansen christine chsh ciphersuite circumvented
cistron clarifying cligen clockwise clusterfs cmap coccicheck codesign coerces coincide coker coldfusion colgroup collab collate collateral colorized
colormode colorstring combiner commentary communicated complaining complaint compressors comstyle coneharvesters conformant conill constantin constructions
contractions conversation convolve coordinating corbett coreteam cormier correia coulson counterintuitive coypu cppgc cpuinfo crawdad crawler cray cred crequy
cripps croatian cuba cumprod curie customer customers customise cutting cyber czerner damaged danielschaefer daniil dara darcy darktemplar daroussin darrick
daryl dashjr dbind dbutil ddir deadlocks dealt debugfs decline decompresses decreasingly dedent deducted deduplicated deems deepequal deflation degraded
delivers demchenkov deokjin depot dequeue dequeued dereferencing deregister deschner deselected destruct detaches detector determinant devtoolset diagnoses
diagonally diamond diffing diminish disadvantages disassemble disc discontinuities disposal disproportionate distant djgpp djwong dlenski dmitrycvet
dockerfile doghonadze domenic domsch donation dosenpfand doubled dover downs downside dprintf drastic drbg drijf dropdown dstack dstream dtext dtls dufresne
dummyatk durham dyalog dymond dynamicaly earthwave eased easing eats ebcdic eberhard ecma ecparam eddsa editorconfig eeppeliteloop egal eindhoven elias elta
emil emission employees encapsulating enrich enumerability escapechar eslintrc essence estangler etag etienne evict evil ewah exchanges exhaust existent
experienced exponentiation exts eyet fabiankeil fabulich facade faced factorial factoring failobj fallbacks fallthrough falsey farazmand farnung fdlibm fdopen
fdrake fdst fenwick fermi ferror fiat filenko filezilla fingers finn finnish fipshmac firedfox fixer flakes flakey flakyness flaw flawed fleury fnal foldr
fontsize food forbes forcibly fortuna fowler framed francoise freenode freezing fsfe fsmap fund funwithsoftware futile futureproof gadi gallacher gallek game
games garygsc gaynor gchecksum geir genuine geospatial gernler getsockname ghedo giflib gitwiki gjasny gladman goaway gost gotchas gotten gozem grace graft
gratitude griffis groenlund gromnitsky grossly gruvbox gssapi gssrpc gtkcomboboxtext gtktoolitemgroup gtktoolpalette guarded guid guile gunidecomp gybas
habersack hackerone hacking hacks hahn halflife hands hani hardly harfbuzz harrison hartwig heider helge hell hellip hemanth herbert hermevander hermvander
herrenschmidt hesiod hexbin hidetoshi hiller himself hirano hkario hoger hops horelick hotfix hourly housekeeping hoyt huang hulin hungry hyperlink hyperlinks
iarna ical iclub ignorenulls ihsinme ijackson ilkka illumos imagined imitating immune immutability inbound incentivedesign income incur indeterminate
indexable indications inds industrial inertia informal ingvar inih inotify insisted inspectable inspects institut instructed intercepts interfacing interfered
intermediates internalized interpretor interrupting intimate intra introspected investigation investigative ippolito iprop iranian issctype issubdtype
issubsctype itanium itertools itumaykin jacke jacobowitz jaredlwong jaroslav jarrod jasan jasny jelen jessica jiang jimb jimrich jinja jitendra jjelen jklimes
jkrems jmorris johann jonah jorma joshgav joyeecheung jozsef jpalus jrnieder juffo junliang kadlec kadlecsik kadmin kanavin karger kario karo karvonen kasher
kazlib keepends keil kelly keyhan keyid keypad kfarnung kinoho kislyuk klein klode klute knowing kobayashi kocharin koepp koschany kosse kost kostik kprop
kproplog krbdev krenair krenzelok kreutzmann kroosec kropelin krzysztof ktls kurchatkin kurihara kuznyechik kwset kzhao laboratoire lagvander lamouri lanoix
larissayvette lark lateral laurence lczerner leader lean lechtenboerger lefevre legs lehman leimaohui lenski leobras leveraged lhomme liang libdane libevent
libexec libgnutls libpthread librt libsecret libstemmer lichvar liezhi lifetimes lightly lili linden linebreak linewise linkers linkgoron linkname literate
logdump loic lookbehind lovell lsattr luck luckily lucky luisgf lundqvist lzip mabrand magma maier maierman mainloop mais makarenko maks mancill manterola
mantissa maohui mapreduce maraschi marginally marshal martinsons masi matchers matthewloring mature matveev matveychikov maxheap maxlinelen maxsplit mbakke
mcatanzaro mcdonald meanwhile mechanically mechglue medians megabyte mehmood memoized memorized memxor mergetools meskes messagebox metz mgrid microbenchmarks
microtasks mikko miles milestone milestones mille minecraft mingye minqi miquels mirix misaligned misbehave misdetected mismatching misparsed missingissuer
misterdjules mklost mkrtchyan mksnapshot mlang mlichvar modal modeling moerbeek moira molnar monitors monk monkeypatching monreal moraes moris motif movie
mraz mrecarray mudit muenzenmeyer mukrop multicall multilingual multiplying multirow munich mustieles mutability mylesborins mysql nagle nakamura nanmedian
nanvar nathaniel nationals naumov naval nazard ndigits ndmin neighbours newmon nfkc nikiforov niko nikola nisse nodeset noel nonunix nonweiler nordstrom
noreturn norms notarization notations noticing npocs nsivov ntyni nullify nullprogrammer numeral nunique nussel observers occasion occurences ocsptool oddly
offog ohme okamoto olga omoris onabort onmessage onread opal openconnect opendnssec opportunities opterr optgroup optionflags osher outright overcome
overdetermined overflowed overlay overruns overstrike overt oxman packagemanager packagename packager pairing panix paradigm parenthesised participated
partners pathdirnamepath pathological patience patrik pausing pavlu pdknsk pechkurov pelletier percpu perex permabit permille persisting pertains pgrp
phenoelit phonefactor phunkyfish physics picky pidst pings pipelines pisar plist pmgdeb pmhahn pmonrealgonzalez pngtest pocs poke polyutils polzer popping
populates porkrind pornin portage portiions positionals possess postgres postpone postrm preauth predicting predictor prefinish preloading preposition presses
pretends prettify preveen prevention previews princejwesley printout prioritise privat proactive proactor probabilistic proceedings procfs profil projected
protections protos provable psmarshall publications puff pujin purchased purple pushdown putmask pyperclip pytester pythons qingyu quadrature quale qualifiers
quarantine quathamer quemerais queuing quynh racily racing radius rajramanca raman ramey randers randolph randomart rapid rashish raslan rassen ratings
raudsepp rcorreia readelf readfile rebound recalculation recompiled reconnecting recovers recreating recursions refcount referral refinements regier registryd
regressor rehype remko remo remus repacked replaceable reread reschedule residence residents resolv restoration rhodri rical ricaljasan rice richards rickert
rickyes rinfo rint riseup ristioja rlwrap robertonewmon rodrigo roee roff roguez rootdir rootkea roperator rotated rotating roumen roux rowanthorpe rowe
rpcsrc rpearson rpmfind rrtype rtime ruano ruifeng runtests rxspencer saguer salary sales sanders sandia sanvila sarat sasaki sasldb satiro scavenge scene
schalnat schannel scheck scheel schleef schneeweisz scholz schouten scissors scol scorecard screens screwed seamlessly searchengine sebdeckers securitycode
sedoi semblance sensibly sensor sensors sequencing sergeant servertimeout setera seterr setstate settlement sexp sgybas shadura shankar shard sharuzzaman
shedel sheer shuffles sibbald sick sideways signalled signer signes sikkes silbermann similarities simonsouth simplifying sims simulated simulating simulation
sirrix sivov skipfooter slated slave slope slowed slowly smalltalk smime smtp sneves socketbuffersize socks softmax solie someday somefile sonawane sortable
sorter sosedkin sout spafford spake spanning sparsity spectralink spending spends sperberg spnego spoof spool sqlalchemy squashing sree sreepurnajasti
srinivas sskaje stangler starred startcol stashes statics stbuehler steal steen stefanb stefw stein steinke stelmach stepan stepanyan stepping stlman stolen
storm strengthen stretched stribley stripspace strstr strtoimax styleguide subarrays subexpressions sublicenses subpackage subscribers subsequences subshell
subtitle subtly sucha sudan suman summer sunrpc supplement suppresses surround survives sutherland svintsoff synopsys syria sysconfig sysdeps systemtap szidek
szmigiero tailored tajima takashi tamil tango taobao tapering taptestrunner tarbe tausq tcltk tdbtool tellnes tempdir temperatures temptation temuri tens
testbbox testcalendar testnouiprint textview themed theo theodotou theorem thoger thursfield tibshirani tidelift tiger tightly titlebar tlsfeature tlsproxy
tmancill tmpfs tmraz tniessen toddy toggles tokenizing tolist toml tommy tomvrancken tortious toshiyuki tquemerais transactions transliteration transparency
transpiled tridgell trotta troubles trustworthy truthful tukey tumaykin tyni typefaces udpate uebernickel ukrop ulises ulong umount unanswered unbreak
uncompressing unconsume uncovered undergo underscorejs undetermined undoes unfilled unforeseen unicodedata uninstallation unistring unittests universite
universities unlicense unnoticed unpivoted unportable unresolved unsatisfiable unsatisfied unsetenv unsqueeze unsubscribed unterminated unwise updater
uppercased urandom urban userspace utime utopios uunet vakil valencia vanzandt vardanyan varun vasin vasprintf vcatechnology vcelak vdeturckheim veit
verdoolaege verma vertex verto veryflatcat vetterling vijay vista vita vollant vrancken vsnprintf wabtec waitpid waldi warm watched wcwidth weekmask welinder
wenqing werror westerfeld westman wexelblat whamcloud wherewithal wickman widmer wiedemann wikis wildmatch wilhelmi wimer windl windriver wink winsock
wishlist witchery wizy wolff woodhouse woods worcester workload worthwhile wraplength wrongly wrymouth wunder xattrs xdgmime xdist xine xlabel xpath xtables
yahan yamamoto yazhong ycbcr yihong ylabel yscrollcommand yurukov zackw zahari zandt zephyr zfridric zhaoxin zidek zips abcdef abortcontroller abortsignal
abouthiroppy absorb abstractmethod accelerators acct acqpkitstatus activestate adhered adil adjectives affiliate affiliation aforementioned agilent aguilar
aids ajax ajhager ajido akiyama aladdin alarm alberta alfie algol alhadis allkeys allowlist alpm alsa amanpreet amelia amet ameta amiss amused amyspark
ananian anastassakis anchoring ancillary andrade andrasq andrea andreoli andrews angel anguilla animated anne anno annual anonrig antialiased anticipation
apapirovski apenwarr apibuild apilinks apostrophe appendable applet appleton applets apthorp arduino arenas aristotle arraysize arrowsmith artifex artwork
arun arya asctime asencio asfreq ashimine ashok ashworth assigner assured assures astronomy asymmetrical asymmetrically atlassian atoll attachments attractive
attributed attributing atts auke authmethod authobject authoring autodetects autodie autoflush autofocus autoloaded automates automating autostash awoken azez
azul azzola backspace backtracking bacon bailout bajanik bajwa baldassi balintreczey banasiak barbier bareword barewords baril bark barnes barthelemy basedir
baseurl bastemur bauch baudis bcrypt bdale bdfoy bdschuym bearing bearssl beautiful beckert behrmann beings bekenev bela bellcore benchmarker benefiting
benign benjamingr berkenbilt beside bgzip biased bicha bigints biham billion bilochub binned binwidth birunthan bitbake bitbucket bitebene bitstring blacklist
blau blib blksize blowing bluetail blur blurred bmuenzenmeyer bnocera boardman bonfils boring borland bota bottleneck bottommost boulenguez boumans boyer
boyuan bozeman brabandt bracketed bracketing breadth breedt breitner broader broadest broadly brother brouer brunei brute brygin bsdstubs bswap btimothy
bubbling buchcik buchert bucketizer buff bufferkmaxlength bufsubarraystart builddate builtinlist buji bulleted bunce burden burren bursztyka buzzword
buzzwords byrne bzero cachebleed cachecontrol caja calamandrei calltip cameron campbellfamily capath carboni cardinality cargo carretero carvalho cataldo
catgets cavok ceases cebuc cedilnik celestin centralized centroid centroids cereal certainty certified challenge chameleon chandan changeset chanop chapel
chapters characteristic charmander chatterjee chebvander checkable checkansi checkimports checksrc chegham chfn childs chookij chooser chromatic
chronologically churn cidr cihar cimag circles circulate ciurana classifications classprefix claudiahdz claudiu clearify clee clicks clipping closable clubs
clubshib clue cmsmcq cmssm coalesced coarse codeblock coderaiser coderef codify coleman collide colno colomar colorizer colorscheme combobox commander
committish compatability compil compileall complevel complib composes comprises compuserve comx conceivably concisely conder conference conffile confident
confidential conformed confs congratulations conjugation conncache connector consolas constituent consultants controllable converged converion conway
cooordinates coopercc copyto coreutils corion corportation correlate corrupting costamagna countermand coveralls covington creal creators criss cropping
crozat crypo cryptic cryptix cryptogetcurves cryptogethashes cshl csmall csound ctags ctext cubic culprit cummax cummin cunningham cured curious curlies
curtis cutoff czech daft dagenais dagfinn dague dahyabhai daiderd dalrymple dalton daly dangaard dangers danish dankogai dantti dario darkbg davar dayofweek
dcpos dcposch debadree debounced debuggers dedicate deduce deepcopy deference deflated deflating defs degrade dejavu delegator deleter delim delimiting demir
denicola dentato denying deopt deoptimizing deparse dependant dependents deprecating deprive dequantize dereg derivations designating designee desrt destpath
destructors destructure devch deviate deviates dhparam dictated diffed differential difficulties diffutils digging digitalinfinity digitally diogo
direntparentpath disallowing disambiguated disassociates disastrous discernible disclosures discontinuous discovers dispersion dispute distlib dists divides
dktrkranz dlmalloc dmabupt doctor doddannan dojo dolor domenico dominates dong doogie door dorfman dortmund dotless doubly dougherty downsides drabczyk
drastically drawable drawables drchip dronamraju dubois duin dulmandakh dumpvalue duncan dunno duplexify duties dynalink eadrogue eady earth easter eastman
economy editwin edsadr edwards ehsan eichin eigh eigvals eigvalsh elaborations elapses elberger elbrus eldorado elected elegant elise elizabeth elliott emin
emojis empathy empirical employers emptying encguess encloses encompasses engelhardt engelschall enhancing enlarge ensue entanglement equi erculiani erdal
eriberto erich ericsson erin ernest eryq esatclear escapable esoteric esperanto estliberitas eungkyu eurodev evaluations everitt evolved exacq execvp execvpe
exif expendable explicitely explicity exploitable exploratory exponents exsltexports eyrie ezequiel fabien faking falavigna falsely fancyvrb farin farrell
fastapi fatih favourite fcrypt fearing feeling feels felt feltzing female feof ffffcc fhinkel fibonacci fictional fieldset fifo figcaption figured filelist
filetuple filing fillvalue fillx filly film filt fingerprinting firewalls firstname fischer flanagan flatmap fleshed fletcher flexibly fmtcheck focusin
focusout foka foldl folta fontawesome fontconfig fontlist fools forbidding forbids forgiving formalized formulas forney fousse fragile fragmentation fraser
frederick freegates freelocale freezes freopen frexp friday friedensohn friesenhahn frii fsaccesspath fsexistspath fsopenpath fsreaddirpath fsreadfd
fsstatpath fssymlinktarget fstat fswritefd fswritefilefile ftplugin fuchs fuddl fuji fullmatch fulltext fundings furlong fusions fysh gabi gagern gandalf
garret gaucher gbacon gcovr gdams geddes geek gene generis genroot genserv geophysics georg gerard gerfried getdate getdelim geterr geterrcall getgid
getgroups gethostent getitem getpagesize getpass getpeereid getpeername getpgrp getpwnam getpwuid getsockopt gettz gevers giampaolo gianfranco gids giffuni
gimp ginchereau giorgio giovanny gitlink giuseppelng glaser glatzor gleaned glyph gobject gomez gonggrijp gongora gorcunov gorez gory governs grafted granada
grand granular graphically graphviz graz greffrath gregoa grew grids groupers gruenschloss gsar gsasl gunderson gunthorpe gurusamy guus haardt hadamard
hadrons hager halfway halse handshakes hannover hannyaharamitu hardcopy hargreaves harms harper harry harshitha hartmann hashability hashupdatedata hastie
haswell hazardous hazards headersonly headless healy hear hegbloom helgefjell helmutg helo hemert henkel hermon hexten hhmmss hietaniemi highwatermark hindi
hipp hiremath hoard hobbs hoersken hoiho holme holmquist holser honoring hoping horror hoskins hotkeys hovering hufthammer hugh hugues hundreds hurtado hwaci
hwmon hygiene hylke iamchenxin ibmi iceland icky idan idlharness idoc ifft ifftn iframe ignacio ihlenfield ikko ilic ilmari imitation immunities implementer
impractical imputer inaccuracy incredibly incurring indefinite indexables induced inevitable inferior inferno infinitely inflect inflected informations
informing infozip infra inftrees ingress ingy inherent inheritable initasyncid initgroups injecting inout inputfile insanely insensitively insertbackground
insertions insertofftime insertontime insertwidth instituto insulate insure intercepting intercode interestingly intermixed interoperating intervention
intlmacosx intraline introducti inttypes invalidating invalidcommand invention invites inwap ionescu ioremap iowait ipset ipsum irfftn irregularities irwin
isatty iscygpty isis iskore islam isprint isupper italiano italics italoacasas itemizedlist iteratee iterparse itvl iuculano iyer izhak jacoutot jaideep jakov
janak janne jarkko jarsolav javac javah javis jbailey jbergstroem jbicha jdalton jdhore jefe jengelh jenness jensen jeroenooms jersey jgit jhamhader jitter
jname jochen jonno joost jopt josep jpeacock jpegi jrburke jscott jsonc jsonlines jukka julianduque jungshik junshu jurczyk juri jwilk jython kallal kamil
kanasewich kane kaneider kanika kapke karan karrys karthik kasal kaseorg kasimier kastner katakana kaufman keeley keithp kenan kentico kenticocloud keyfile
keyset keysym khash khrplatform kibodeaux kills kirby kirch kitt kitten klassen klauke kleen kleene knechtges knowingly knudsen koala kodak koehler kogman
kohan koichi konrad kooi koron kosch kowalski krafft krause krawczuk krischik krishna kstarsinic kulow kunalspathak kvakil kvale kysela labelframe lacking
lakshmi landgren lauridsen lawfully layernorm leeight lees legalnotice legvander leigh leland lemke lengthen leonhard lesspipe levenshtein levon
lexicographical lflags libcap liberation libfreetype libharfbuzz libiptc libjavajpeg libjpeg libksba liblcms libmisc libname libpkgconf libprereq libsodium
libsplashscreen libssh libtest libvterm libxtables libzip licences licquia liebdich lightbg lightness lincoln lindstaedt linecache linejunk linewidth ling
linguistics linters living localeconv lockf locs logarithms longo longtable lookalike lorem lossy loudly louis louridas lowe lowering lpia lstein luberda
lubkin lumish lutimes lxnay lyasotskiy lying mace macke madara madduck madhuri maginatics magnetic magnusson mailboxes mainstream maischein makamaka maki
maldives male malmberg malta manageable manfredi mani manufacture manuscript marasystems margo marigold markupsafe marshalled maskedarray mason maszkowski
matlib matmul mattijsen maxon maxpool mayank maybach mbedtls mbsi mdast mdtsoft measurably mechanics mediawiki medozas megabajt megabytes memmap memmem mercer
mercy merejkowsky mesh messageheaders messagesocket messagetrailers messy metacharacter metaconfig metafunc metainfo metamail mforney michel migrated mimetype
minchan minima minimatch minimized ministry minority minozhenko miscount misidentified misleadingly misnamed misreporting mistook mistyped misunderstood mixes
mkcodecache mklink mknod mkppport mktime modax modeline modelines modelled modernization modestas modularization modulename mohanathas momtchev momtchil monad
monet monsanto montazery moolenaar moreno moria morovic morphs mortalized motd mprotect mqtt msbuild msdn msgfmt msgrcv msgsnd muir multicolumn multimail
munging murthy musse mutator muthukrishnan myanmar mykola myllynen nagel nalborczyk nanmax nanmin nanosleep nanstd natanael nauru nauta nbar nbsorts ndiff
neal necas nedmalloc needle neeraj negates negligent negotiable nemer nemerson nemours neon netconnect netdev netlist netstat neundorf newborn nfsynproxy
nichols nickzman nico nicola nicoletti nigel nikolaos ninety nisa nixon nobuhiro nodedata noescape noffke nominated nonamefile nones normalizer nothingmuch
notna nowadays nroff nthree ntree ntuple ntwo nulled numerals numf numification nutshell obergrusberger octavian oguz okir oldrev oldsberg oleksandr oliveira
onestep onnxrt openat openpty openpub opsera optical optik optim optimistically optimum optionsstdio optname optype orangemocha organizing orgs ortega
ortvalue oscar osmond ostif ostrich outlist outlived overhauled overline overwhelmed ovid oxford oyyd ozan packagekit packstream paddings pagaltzis painted
paints paktronix palfrey pandora panes panghal parallelization parametrizations parra parti participant particle pasky passthrough pathhelp pathways patreon
pawan peacock pearce pearcey peeked pemberton pencolor penev pensize percival perfctr perldebtut perldiag perlebcdic perlembed perlexperiment perlfaq perlfaqo
perlfilter perlglossary perlgpl perlman perlmodinstall perlperf perlpod perlpodspec perlpodstyle perlport perlreftut perlrequick perlretut perlsub perlsyn
perlthrtut perltraining perlunicode perlunicook perluniintro perly perms permute persistently personally pesquisas phony pickier pigz pike pinard pinpointing
pipx piscisaureus pkgconf player plays plenty plink pluck pluginmanager pmqs pngpriv pngrio pngwio podlators podtelezhnikov pointwise poking poldek polite
polluting polyfill polyvander poonlap popies posixpath poskanzer posteo postgresql postponed postrouting powerdog pracucci preconnect predecessors predescu
preferentially preformatted prentice preopens prepacking preparatory prereqs prescribed presets prices prihateam pritikin processkillpid procurement producers
productive profiled progressively progtest prohibiting prologue proportions prover proves provost pruitt pryce pseudoheaders psmidx ptrace putenv putty
puzpuzpuz puzrin pybind quad quantifiers quantizing quartile quasi quillan raadt rafaelgss ragnar raisinten ralph randy ranjan raspbian ratpoison raysatiro
rdentato rdev reactor readablereadsize readlink readv reallocarray reallocation reapply rearranged reattachable reattached receivers reception recompression
reconsider reconstituted recursing redeclarations redeclared reenable reentr reeves reexport refcnt reformatted regexps regis regress regulated reini
reinstatement reinstates reintroduced relay releaseinfo relinquishes relinquishment reloaded relu remap remapping remediation remedies remembered rennebarth
repartitioned repeatdelay repeatinterval replays reposition representatives reproducibility rescale rescinded resistant resizing resolvent responsefinished
resumable resurrect reveal reviewers revisited revoking rewording reworked rexagod rexx rezic rfrancoise rgba rhysd richie ricky ridgewell ridolfi rieger rigo
rinaldo risky rkrishnan rmanfredi robie robustly rock rogaway rolsky roques rotty rouchal roundtrips routable rowvar rsplit rsync rugvip ruigrok rustfmt
rustls rwlocks sabayon saddr safecheck salmi salmon salts salvestrini salveti salzenberg samlp samueloph samuli sanden sandy santuario sapin sarathy sascha
sasidharan saslauthd satisfactory savannah savio scaler scary scattered sched schillstrom schmitz schnelle schultz schuymer schweigler scraping screw screwy
scrollable sdbm seal seamless sectransp seeded seeks segfaulting seibert sells semaphores sergi serializations sesse seterrcall setgroups setpgrp setregid
setreuid severability sfrost shaas shakeel shark sharnoff sheeter shellcheck shelor shibboleth shikadi shire shisama shiya shortname shove shrestha sidebars
sidewinder siegel sieve sigaction signaled signtool sigprocmask sikora silenced simd simone sisu sivaraj sizing sketches skomski skurydzin slang slaven slavic
slip slootman slowdown slows slurpy smalloc smartmatch snek snowman socketref soeller softirq solarized solitary solomon sortedcontainers souza spatch spatial
specialize spectra spewing spliced splicing spoofed spotted spreading squaring srand sreeves srid ssize ssrg stall stan standing starkwang starsinic startrow
statatement statespec statistician stdcall stdint stedolan stefanmb steinar stemmed stepped sterchele sterchelen strace straightened streamlined stretchfactor
strtol strtoll strtoull strtoumax structurally sturges suarez subdivide subelement subfolders submits submodel subpatterns subprocessstdin subprocessstdout
subprograms subs subscriptions subsetted substantively subtracts succeeding succinctly suckless suffices suggesting summing sumners sune suominen superior
supersedes supplements suresh surfaces suspected svelto svens svetlikova swapcase swarm swedish swiftgyb symmetrize synaptic synched sysconf sysexits sysinfo
sysvinit szegedi tabsize tabwidth takata takeable takeshi tale talked tampered taper tarek taro tayar tcsetattr teardowns technosystems teich tektronix teles
temperature temporal tensorflow terminations termios testable testanything testclean testers testpy tevp textdecoder tftpd thang thealphanerd throttled
ticehurst tickprocessor tilera tilt timesteps timestr timeval timlau tion tipo tmpfile tnode toascii tolerances tolerant tomoyuki topologically torbjorn torin
torkington torri tortuous totals touching tower townsend tput tracy trades tradiaz traduzione trait transcode transit transposes transposing trapezoid
trapezoidal trappable travel traversals treaties trims triodef tripledes tristian trofimovic trojette trolltech trout trustees trusting trusts tunnicliffe
tunniclm tuputcyn turbojpeg tuvalu twoshortplanks tycho tycoint typename tzset uchiha ufomechanic uids uiuc ulink unacceptably unacknowledged unassigned
unavailability unbackslashed unblock unbox uncertain unclosed uncompleted undefine underlining undobuffer undoing undue unecessary unencumbered unexecutable
unfolded unformatted unguarded unicore uninstalling uninteresting universally universitat unload unmanaged unmask unnormalized unpinned unpublished unread
unreasonable unrefd unreserved unroll unsent unskip unsound unsurprisingly untagged untie untransferable untranslated unworthy unwraps upsampled upwards
urgent urlopen urlsearchparams ustack utilformatformat utilizes utmp uuencoded vainius valeriy valgrindpp validatecommand vanatham vandine vapier varchar
varied vasili vauth vendoring versatile vertices vfile vhrel viers viewable viewers vilar villa vipin visiting vitale vkurchatkin vlasyuk vmax vmin vmsish
voice volker volkmar vollbeding voon vpanghal vromans vscode vsock vsplit vssh vstu vtls vtune vuorela warasin ward wassim wast watts wayland wctob wctomb
weaker weaknesses weaver websocket wegscheid weimer welsh werven wglext wglxext whale whine whitelisted whitlockjc widen widened wildenhues willcox winfield
wing wings winton wisdom wisely witch withdrawn withheld witte wlug wmname wnagel woobling wood workerthreadid writablecork writableendchunk writableuncork
wsutils wyse xcms xenial xerces xerox xlim xlrd xmalloc xport xticks xtoptions xxxxxxxx xzless yael yaniv yanked yeti yggdrasil yigit ylim yticks yuriev yves
yyyymmdd zakharevich zalloc zaman zconf zeigen zenin zfree zhou ziefle zijian zilong zitzmann zlibbyteswritten zoran zuzana zypp aayush abandon abdalla abel
abilities abnormal abnormally aboukhadijeh abov accents accentuates accessions accommodates accomodate accum achiev acid acknowledging acos actionable actor
actorder adaption addit addressable addrinfo addtogroup adequ adherence adhikari aditya administr admonitions adown adtype advantag adverse adversely
advertisements advis adymo aeiou aeiouwxy aeiouy aeiouylsz affiliated afif agda agenda agner agreeable aheared ahkrin aidan aileen aiming airmail aitken akash
akfedux akhgari akim akito alam alena aleph alessio alexandru alexcfyung alexl algebraic algorithmic alignable alignments alism aliti alize allclasses
allegedly alli allombert allowance allowlists alltitles almond alnyan alphanumerical alphas alreadi altern alvaro alwai amar ambassador amitakhya amitay amos
amplify amrios anand anarey anas anatoly anawesha ance anci anew angles anim animating annotates announc announcements anoff anomalies anonymously anoth
anshul antonov antoon antoro anyways aonghus apostrophes appdata appease appengine appli applic apprentice approaching appropri apptype arange arangel archaic
architectur archiv arctic argpartition arithmetics arjen armored arnau aronovitch arraybuffer arseniy arxiv asanyarray ascmagic ashfield ashita ashraf asian
asin assaf assistant associ assuan astraw atan atari atext atime ation ational ative atomicity atoms ator atrioom attard attenuated attname attributeref
attroperties attrtext australian authen authorgroup autoclass autocorrelation autofixer autoheader autom automat autoplay avail averages averaging awai
awaitables awareness awpguy axentia axkit aymen ayush babygoat backbone backgroundcolor backgrounds backporter backreferences backslashed backtrack badral
bails bake baking ballombe bamieh barbato barri barsky baseclass basenames batra bauerschmidt bdwn beckwith becom beebe beeson befor beforebegin beforeunload
beginners behren beldan benfinnei beni benjamini berkman bernard beshay bezooyen bhargava bhat bhavani bhtml bidur biedl biggest biliti binari binarizer
binddynport binlog binning binnmu biowski birds bitandbang bite bitsize bjarni bjdelro bjson blanche blanco blew blind blinking blknos bloated bloom blosc
blot blower blown bluebird blueprint blugavere bluhm blumenstingl blurb bmeurer boarman bobbio boeckel bogatov boivin boldquot bonawentura bondarenko bonnet
bonus bookstore booktabs bootstrappers borrowing botello bothner bottomrule boud bounty bouvier bowler braakman bracey brainfuck branding brandl branko
brennan brent bretton brezac briefly brinkmd briscoe british brody brownlee browsable bucketed bufferatobdata bufferbtoadata buholzer bulgrien bullsey bumping
bunches bundesamt buren burklund busdaycal busdaycalendar bushell busted butler bxml byang byob bystrek bytecod cable cabrera cadieux cage caio cairographics
cairoshape cairotwisted calcul callbackified callbackify callbackserver callewaert callings callsfunc calories camelizing campo candid canonicalizes cantrell
capit carmen carmo cary casal cascaded casey casual catchall catfish caus cbreak cctests cderror cdjpeg cdnadmin cecchi censor centralise centrally cepeda
cernak cexcept cgroups chachamu chaos charjunk charmap chartered chase chat checkboxes checklist checkouts chemistry cheni cherrypick chetan chgrpdir
chgrpskel chiahao chih chiras chirgwin choa choos chrisccoulson christie chuck chyl cinamod cinnamon ciphergetauthtag circuiting circuits circumflex cisco
citizen cjpeg ckfw classifiers classifies clientcertengine clienthello clines clnt clumps clutter cmakescripts cmyk codeowner codepage codepages codeql
codereview coderules coercions coffee cogito cogroup coherence coherent coincidence coinciding collet collier colorama colorbar colorization coloured
columnwise combinator comcast committers commutativity comodo compability compactly comparions compensated competes complementing complet complication compon
composing comprehensions compressibility comstedt concatenations concats conceal conceptual concetation condensing conducted configfiles configpars configur
configurator confounding confoundingly confus conjecture conjugates conley connectionless connexer conor consensu conserve consisted consonant constantine
constrains contention contextifying contextmenu contingency contingent continu continual conveni converse convoluted cooperate coordin coordinated coords copa
copi coreybeaumont corn cornerstone corr correctli correspondig correspondingly corrupts corsi counsel countless cours courses courtney cousin covenant
cowgill cpbs cpuid cran crate crazy critchlow croptest crosslink crummey crunch cruz cryptofips cryptsoft crystal cssom cultures cumulated cups cutter cvenum
cwryu cyan daemonize dale dampening dana dancer darbois darcs dare darker darling dasgupta datastore datefmt datetimetz davidson dayofyear daza dblclick
deactivates deadlocked deallocates dealy debhelp debianised debuggability debugtrace decapitalize decharter deciles decipheriv declar declatory decls dedic
deepthi defacto defaultfmt defeat defeating defenses defin deischen deity deletechars delight delineated delvedor demaille demanded dempsey denny dependabot
depicting deploying deprec deprecates descends descore describ descriptio desdata deserializer designations designers designing desir destdir destructured
detaching detectable detectors detroit deviance devn devon devoted dfabulich dhowells diagflat diana dice dicearr dickson didn diederik diekhans dilinger
dirceu dircolors directli directori direntpath dirfd dirhtml dirpath dirruns dirtbik disabledness disadvantage disagreements disagrees disassembly disaster
disattached discourse discretize disjoint dismissed displaylist displayof disposition disregard dissimilar dissolution distcheck distinctions distinctive
distribut district distutil diverse divisions divlo divyanshu djihed djpeg dkuhlman dlcompat dlerror dlfcn dnalborczyk dobbertin docname docnames docserve
docsrc documenta documentaton documentcloud dodge dohse doku dolapo domenichelli dominique donarmstrong donawa dorman dotfiles doublequote doubts downgraded
doxyfile drag dragon dragto drane dribble drift driving dsplit duarte dublin duft dukas dumitru dummies dupont durable dure dutch dvornik dwim dyld dymo
dynsections easili eccdata eckenfels eclared edgeitems editables edmonds eduardo education educational eeeeee eglug egnor egor eighth eileen einstein eischen
elbert electric elifantiev elimination elit elixir elric emanuele emax embargoed embedtest ement emma employ employee emptiness emssage enabl ence enci encod
encourag encouragement engagement enhances enormous enriched enshrin ensonic ensur ensured entails entangl entir entitlements entli entri envversion eqeqeq
equalities erased erez erickwendel erlang ernst erwinwahyura escalate escaper eschew eschright espinasse esri esteban estienne estiven etype eugeneo
euidaccess evade eventloop everi evidence evolution evoque exaclty examin exampl excallback exclud exclusivity excoffier exctract execut exegin exension
existance exoego expandable expando expansions expend experiencing expertise expl explanatory explicitli exsl extens extents externals extundo eyeballs
eyesopened fabbe faccessat facilitating factories factorized facundo fagerholm faithful faiz farid fastparquet fchdir fcssescape fdatasync fdopendir feign
feldman felipec fence fenced fenton ferguson feross ferreira ferretti ffaaaa fhdr fiedler fieldname fieldsets fiertek fifteen fiji filedescriptor fileinput
fileio filesize filetest fileutl finalizing findings findutils finfo finnag finnei firstch fixable fixtres fixturedef flandre flatbuffers flatiter fledged
fleischer fliplr flipud floatmode floatnumber flockfile floodyberry floppy flux fmizzell focu focusinfocus focusoutblur folderclosed folderopen foolproof
forcefulli forge forgetfulness forgets forgiveness formorer fortin foundat foundational fptr fpurge framing frans freedman freeglut friedly frob frolov
fromlines fsappendfilepath fscanf fsclosefd fscpsrc fseek fslchmodpath fslchmodsyncpath fslchownpath fslchownsyncpath fsmagic fsreadsyncfd fstatat fstatfs
fsunlinkpath ftbfs ftplib fuctions fulfillment fulli fulness funcdef funct functionish funescape furstenheim furuseth futimes futur fuzzers fxshow gaara
gabriela gajc gallant gandy gangstad gasparyan gathers gavin geard gecko gener generality generalize generically genfromtxt genrsa gently geographic geomspace
gerardo gerfen gerges germann geronimo gertzfield getall getauxval getc getcontext getdomain getegid geteuid getgrnam getnetconfig getnetpath getpublickey
getrandom getrpcent getrpcport getsubopt gettime gettimeofday getuid geyer ghaiklor ghash gintautas gioyik girardi gislason gist gitcvs gitexecdir gitview
glade glaubitz glavan glavina glessner glitches glossari gmazyland gnatenko goldfish goncalves gonda gonen gonna goodies gopher gorski governor gowpen gprof
gpus grabs graciously grande grantor granularity gravatar gravity greathouse greco greene gregbook griffith grigory grobgeld grubb gruppo guarante guardian
guava guerrero guicent guillonneau gulotta gutter gzlog haase habit habits habouzit haertel hairy hajin halde halfwidth hallvard halve halverson handcrafted
handl handlewrap harish harold hauge haystack hazard healthy heappop heapsnapshot hearing heat heel helfers helpfully heneise henney herborth hermder hermeder
hermefromroots hermeint hermfromroots hermint hermweight herrera hesse hessian hijack hinds hinted hirani hiroaki hiroki hiromu hirotaka histor hitachi hlist
hmammedzadeh holdings hollander holmlund holshuch homogenize hongbo hookimpl hookspec hookwrapper hoops hopper horizon horton hovers howells howev hsplit
hstrerror htonl httpsgetoptions huber hueffner hugepages huggingface hump humphrey hung hutson hutterer hyperms hypot iansu ible ibuclaw icase icate iceweasel
iciti icmp iculslocs ieee ifconfig ifftshift iframes ignor ignorance ignoretz ihara ikasumi imaps immedi implementor implementors impli imprecise imprecision
impression improv imputation imyller inadvertent incident includ incomplet incomprehensible incurs inde indentations indentwidth independ indexentries
individu inefficiently inelegantly inexistent inferencing inffast inflated informally informaltable ingham ingi initargs initi initrd inname innocente
innovations inprogress inrialpes insid insists instal instanc instantized instantly instructive instrument integr intelligent intensity interdepend interests
interfac interfer intergers interlaced interleaved intern interning interpretable interquartile interrogate interrogating interruptions intersected intrigeri
intrinsically introduc invalidation inventory investigated invisibly invok ionel iouri ious iovec iqbal iris irritating irvine isabelle isalnum isalpha
iscomplexobj isdigit isets ishaan ishaq isilon islower ismap isprime isreal issam isspace italicized iteratees iusupov iveness ivereigh iviti ization izer
jabbour jacek jackyen jacobson jagannath jakecastelli jamo jang janl jaraco jaricom jasongin javuori jcapimin jcapistd jcarith jccoefct jccolext jccolor
jcdctmgr jcgray jcgryext jchuff jcicc jcinit jcmainct jcmarker jcmaster jcolsamp jcomapi jconfig jconfigint jcparam jcphuff jcprepct jcsample jcstest jctrans
jdapimin jdapistd jdarith jdatadst jdatasrc jdcoefct jdcolext jdcolor jdct jddctmgr jdhuff jdicc jdinput jdmainct jdmarker jdmaster jdmerge jdmrgext jdphuff
jdpostct jdsample jdtrans jeffries jerror jessi jessicaquynh jest jevgeni jfdctflt jfdctfst jfdctint jiangq jidctflt jidctfst jidctint jidctred jimi jimmac
jinclude jinho jmemmgr jmemnobs jmemsys jmorecfg joesepi joker jonask jopann joran jorendorff jouk journey jpegclub jpegcomp jpegint jpegtran jquant jquantf
jquanti jshin jshint jsimd jsimdcfg jsimdcpu jsimddct jsimdext jsolomon jsonp jsperf jstdhuff jstest judge judgement judis juho julius junker jutils jversion
kabalak kabir kahan kailean kajiwara kalahastri kaleb kalev kalrover kambanaria kanamaru kanazawa karande karen karlsen karmazin kasyanov katie kato kdevelop
kebab keld kelemen kelleher kennykb kerins kettlewell keyboards keybox keybuk keyfunc keymap keystroke keyup keywrap khafra khaledhosny kharon khineika
khuntia kicking kids kieboom killagu kini kirkham kiwi kiyoshi kkaplan kleinschmidt klemen klopov kludge kludgy kmaraas kmem knittel koetter kogovsek koka
kolmogorov komawar koooge korean korving kovalev koziatinskii krashnikov kratochvil kris krol krynicki ksba kuhlman kuhlmann kuijsten kujau kulukundis
kummerow kunkee kupries kurdi kuriyosh kushchak kwparam kyriakos kysnm lagder lagfromroots lagint lagweight lake lambert landschoff lanz laptop larg
largepages lasso lathiat laura lawler layered lays lazier lball lchmod lcov ldap ldapdb ldconfig ldots learnt leblond leddy ledesma leeuwen legaci lehn leick
lela lember leonard leslie leuenberger leverages leveraging levstik lhash libcrypto libcst libdaemon libexsl libgit libgpg libjpegturbo libldap libnl libpam
librari librsvg libstd libtests libthai libtirpc libturbojpeg licenc licens ligatures lighter lightning likes limbs lind lindblad lindfors lineage linestyle
lineterminator linkification linspace lionel lisp listitem liuxingbaoyu livneh ljust llnode lloyd localizes localstorage locat lockfiles lockheed
locutusofborg loganaden logi loglog logspace logx logy loiret london loopholes loos lossage loud lowercasing lowered lpinca lrlna lseek lucamaraschi lucchetta
lucida lucien lukasz lukekarrys luminance lunar lyonel lzmadec macgowan machado machen macherey mackenzie macrology madcoder madvise mafintosh mager maghni
magnitudes mailname mailsplit mainframe maintype majors makedpkg makemacpkg makenova makerpm makesrpm maketarball maksim maksym maledong malen mamone manag
manchmal mandated mandates mandatori mandeep mangam mango manifests manipulations mantas mapbox mapdomain mapparms mapred marakasov marchegay marian marinacci
maring markakis markings marlena marlow marrec martindale marzelin masaru masquerading massage maste masucci mathbf mathcal matsuda matthia mattloring
maturity maurer mawaregetsuka maxheaderlen maximized maximov maxlines maxmem mayr mays mazieres mbornath mbrtowc mbuf mdate mdorman mechan mediates mega
megapolis meisenheimer meixg mejia melanie meld melissa melnikov melt memcmp mempcpy memrchr ment menudata merchant mergetag merlet mescalchin mesonbuild
messag mesteery metavariables metzmacher mgmt mgol micha micnic midrule miell mihai mikael miladfarca mildly mildsunrise miliauskas millan mimetools minidom
minim minimises minimization minmax minors minsize mintypecode minu mirantis miscellany miscomputed mishandling misinterprets miskiewicz mismerge mismerges
misreport misreported missle mistachkin mistaking mistype mistypes mitch mitigated mixtures miyamoto mjsunit mkamakura mkfifo mkheader mkssldef mktree mmaped
mocklibc modem moderated modf modifi modifiable modp mods modul moduleauthor mohan moinvaziri mojave moldovan mollier moments momentum monkick monokai
moorehead moorhous moose morrme mouett mountable mousedown mouseenter mouseleave mousemove mouseout mouseover mouseup msallowcapture mscdex msie mstormo mtab
multiarray multicol multifunctional multilabel multipl multiplexing multiplies munge murgoitio mydata mydescriptor mydf mydict myghty myller myon myscript
nagesh naghmouchi naively naked namespac namespacing nancy nandaa nano nanos nanquantile naor narirou nash nassri natalie nate navigational ncalls neat
nebinger necessari necessarili nefarious neighbors nemu ness neta netname netnamer netscapes nettype networkno neural neurodiverse neuter newbranch newcache
newfile newparent newrev newsgroups nextafter nextgen nextitem ngettext nienhuis nightlies nightmare nimit ninth nirs nist nitish nitpick nocontent
nodeeventtarget noderivs nolan nomatches nonrepeated noon nord normalisation normality norman normed noronha notmodified noto novice nscd ntohl ntpath nume
numerics numpad nushu objection objnames objtypes observance obsolet obsoletes occcur occupies occupy octave oddball odds odile offici offvalue ofirbarak ohio
oidmap oidset ojas oldfile oldfire olly olson onclick onfocusin oniguruma onli onlight onno ontype onunload onvalue oops opara opencsw openers openhook
openings oper opperwall opposition opsets optall optimise orderings ordinate oren origword orioles orphans osame osdl oset ossl ostmpdir ousli ousness outdate
outlives outputfile outsid outsider overhaul overlined overrid overriden overrunning oxanvanleeuwen pacheco packag packagecache packdata paez pagers paisa
palian pallinger palma palmer panagiotis panidepu panikkal panos panva parallelized parallels parameterization parametric paramstyle pardue parenthetical
parentless parititon parsable parsererror patchset patented pathologically paton peculiar penalize pennarun percdamp percentages perchannel pereira perini
perkins perpendicular perrotte persistance persistant petcoff pete petushkov pexpr pgrep phix phone photo phrased pidof pierrick pietro piggyback pilgrim
pilorz pimlie pink pipelining pippijn pittman pjones pkovacs plaintexts planet platformatic platlib playing pleas plesciuc pmade pmml pngdebug pngerror pngget
pnginfo pngmem pngminus pngpread pngread pngrtran pngrutil pngset pngstruct pngsuite pngtrans pngwrite pngwtran pngwutil pnum pointerenter pointerleave
pointerout pointerover poker polici polls polyfills ponies popularity porchdog portref portunref posada possessives possibl postal postscript potty pouru
powered pragmas pread preallocate precomposed precomputes precursors predates predeclare preflight preopen prepar prereq preserv preservation pretending
prevalent prevod prevompiled prieto printables printers printoptions prlimit prob procedur processabort processarch processexecargv processplatform
processrelease processsetuidid processtitle productivity programmable programmatic prohaska projecting prominence promisesaplus propos proprietor prosper
prototyping proved provid provis proximity prunes psaltis pseudos psmisc psql publically pulkit punctuations punteek puppy purpos putrequest puzzle pwcheck
pwrite pyenv pylab pyopenssl pyparsing pypy pyshar pythonpath pyvers qcontent qinhui qlik qname qquad quantizer quarters queueing quicker quicksort quiescent
quietly quiltimport quinteiro quintero quits quitting quotas raddr radios rain rainer raiskup rajlich ramirez rangecoder raoul raqq rathi raws rbrace rbracket
rchecked rclickable rcombinators rcomma rcssescape rdbmp rdcolmap rdescend rdgif rdisplayswap rdivmod rdjpgcom rdppm rdswitch rdtarga reacting reaction
readcdf readi readings readlinebuf readlinkat readman reapplies reassigned reassigns rebind rebinds recalculated recognise recompil recomputation recomputed
reconnected reconstruction recurrences redeclaration redefining redirections redistribut redistributable reduc redund reem reentrancy reevaluation refack
refactorings referent referential referer refinement reflow refolded refrains regain registrations regit rehash reimplementing reindent reinhard reinstall
reinstalling reintegrate reinvoked reiter rejoin reland relat relatives relaying relbar releas relic remained remembering remov reopening repackaged
repeatability replac replicates replication repopulate repositori repres representer reprocessing requestabort requir requirecache requirejs requisite requote
rescaled rescaling rescan resend reserv resig resilience resistance resolvelib resonance respectful responsive restype retcode rethrown retokenization reutner
revamp revers reversions reviewer rewheel rewinddir rewound reyk reynolds reza rfocusable rfxtypes rheader rheaders rhtml ribose richnologies richter
ridentifier riefenstahl rifkin riluvan rindex rinputs rishabh risking rjsonp rjust rkey rlfe rlidwka rmail rnative rnothtmlwhite rnumnonpx road robertson
roboconf rocky rohan rokita romaniello romankl ronag rooij rostovtsev rougly rouines roukema roumenpetrov roundabout routerman rowspan rparentsprev rpcdname
rpcent rprotocol rpseudo rquery rreturn rrun rsibling rsubmittable rtinstal rtremov rtrim rtupdat rtypenamespace ruan rudimentary ruler rumpf runaway
runescape runge runtim rupp russo rval rwhitespace ryanmahan sacco sachs safeguard saferepr safia safronov saghul sagi sahai saint saito sakhawalkar salame
salman salomon salted sandboxed sandboxing sandeep sandino sandro sanely santigimeno sapics sarahmeyer saratxaga saschaefer saslcache saslfinger saslutil
savez scaffolding scalkpdev scaml scanlzma scatological scdaemon schedul schemenau schizo schlight schoepf schwenke sciences scopeid screams screenshots
screwiness scrollkeeper seaches seals searchdata seccomp secmem secondly securebits securing seedless seeked segregate segu sektion selectcolor semigradsky
sens senses separ seqarrays serde serialised serkan serrador serue serveraddress serverless sess setegid seteuid setpgid setproctitle settitle setuptool
seufer sever sevilla sfere sfun sgrubb shades shading shadowed shaikh shards shastry shay shearfactor shechter shelton sherman shertler shilo shinnosuke
shinya shirekar shlex shlibdep shoes shortcoming shortening shortlex shortli showcases shred shrujal shuffling shull shumow siamashka siarhei sicherheit
siddharth siddhartha sigfridsson sigmoid sigwinch silhouette silver simdjson similarli simov simulates simulator sincos sindre sindresorhus singl sinha
siphash siretart sivaprasanna sizelist sizzlejs skeletal skelfile skipif sklearn skovhus skype slicings slides slowdowns slurped smartcard smash smatsu smoke
smoothness smtplib smuggle snorp snowballstem socketaddress socketdisconnect socketwritedata sofer soffer softmagic softwar sonnenschein sontri sooner
sorarize sorhus sosa sotillo sourc sourcemappayload speakers specif specifi spectral spells spelt sphinxlocal spiesschaert spilling spjuth splices splitbar
sponsors sporadic spotlight spots squeezer squid srcs sshd stabl stachowski stade stalder stamps standardizes stark starovoitov starr startswith starttime
stas statfs statwatcher staudinger stddev steenhoven steinhardt stems stern steved sthibault sticking stipulate stockler stockton storer stott stouder stpcpy
stphane straw strawman strcasecmp strcat strchr strictest strictli strike strikethrough stringifies stripe strncasecmp strncpy strndup stromberg strongli
strrchr strsep strtest strtod strtoul structtjregion structur strvec stty stuebner stuge stype subdirs subexpression subfolder subgroups subjectaltname
subnets subordinate subordinates subpackag subscriptable substitut subsubsection sucap sucess sucessful suck suda suffered suffering suffers suffici suicide
suidperl suitably suixinlei summarizer sunil superscript superscripted supersets supervised suport survival surya suryanarayana suspects suspending suspicion
suspicious suug svensson svnimport swapon swappable swathi sweet swing swol sylvain symlinking symmetrical symmetrically syndata synthesizing syohei sypnosis
sysrq systematic szabolcsit tabbed tabl tagawa tagnames tahoma taht takagi takayuki takuya tanaka tandel tangut tanvi tarang targetted tarith tarsha tartler
tarun tatieze tautology tauware tclxml tctxt teaches tedgi tejwani telka temlate templtaes templtes temporaries tendency tentativeness termcap terse testcfg
testimages testimgari testimgint testmod testorig testscript textbf tfoot thailinux thayil thei thekemkid themename themselv themselve thenability thereaft
thiemo thresh thrower thulin thumbnailer thusly thyrsus tiago tiegs tijhof timar timeoutref timeoutrefresh timeoutunref timeradd timeservers tino tional tirpc
titlecased titleterms tjbench tjbenchtest tjexample tjexampletest tjunittest tjutil tmpl toast tobi toggler toki tokval tolines tolower tomer tomo tomohiro
tonn tons toolbar toolchains toolkits toolset topo toprule torek torque totality toucan tourbin towncrier toying tradeoff tradeoffs tradition trail trainer
trans translatable transmitting transplant transported transromation transupp trapping treeview tresys tribute trickery trivially trivikr trumps trustlist
tsconfig tsfn tsofan tsuneo ttzztztz tuesca tuininga tuna tunnelling turbov turtledemo turtlegraphics tweener tweeners tweens typechar typechecks typedefs
typemap typesafe typic typographic tzfile tzinfos tzname uannecessary udbff udfff uekawa ulrik ultimate umair umath unalignable unallocated unavoid unblocks
unboxing uncache uncatchable uncertainty unconfigured unconflicted unconsumed uncover undeclare undelegate underlies underscor underway unescaping unexpand
unexport unexported unexpose unflake unfold unhappy unhide uninitializes uninstal unioned unionobject unisys univers unlinkat unlinked unlisted unloading
unnecesary unnumbered unopened unorderable unpickler unpin unpiping unprofessional unquotes unrel unrepresented unseen unsets unshelve unstabl unstacker
unsubscripted unsuitable unsupport untested untyped untypical unvalidated unvers updat updatable updatestartuptty upgrad uploadpack upset upstreamed urldecode
urlencode urlorigin urlparse urlresolvefrom usefull usepackage usermod usleep utilisdateobject utilisnullobject utillogstring utiltypes vadzim valdez valu
vandyke variabl varibale varibales varieti variou varnish vasiljevic vass vazina vcproj vcxproj velocity velvindron verbs veri verifier verilog vernooij verse
versionsort viable viacheslav vicente victims videolan viewcvs vigna vilk villars vintages virdi virtanen virtualenvs virtualized visnovsky visualstudio
visupng vital viti vitor vojtech volkerding voltrex voltrexmaster volunteering vowel vperezma vsevolod vulner vuong vuori vyukov vyzo vyzovitis wadllib wael
waited waiter wakes waleed wallace walling wansing warranti wastage watanabe watchman weaken weapon webb webidl wednesday weewey wegrzynek weisgerber
welcoming wesarg western wgdd wheezi whenev whien whiskers wholesale widening widens widespread widows wiggle wikstrom wilcoxson wildly willem willemoes
willhayslett winapi windir windspeed winnow wipe wirt witthawat wizard wkhtmltopdf wohlgemuth wojciech woll wonder woning woodruff workhorse workspaces
workstation wouter wpaul wrbmp wrgif writability wrjpgcom wrppm wrtarga wtmp wwwzbwcom wxneeded xcerion xclip xerr xiaotian xlsxwriter xmllint xmlrpc xmlwrapp
xortiz xsel xtrans xunit xxdiff xzdec yacc yadav yadd yamada yamlish yangyang yannig yerr yesterday yojan yoshiwara youngest yours youtube yucom yuko yuza
zahidul zaki zavery zeilenga zelenov zhangzifa zhengyuanjie zhukov ziade zieringer zipfiles zipimporter zkat zokas zombies zpipe zran zurawel zyga zygmunt
aaaaaa aaaac aaaaff aaccttrr aashil aastha ababab abandoning abbasi abcedfg abdc abdel abdul abdurahmonov abdurakhimov abhijit abiflags abitekaniza
ablacktshirt abmusse abortable aborterror abou abra abramowitz abridgment abscissae abseil absorbed abspath abused abzug academia acceptfont accesslog
acconfig accumulators accusative achenbach acinclude acknowlegement acknowlegements aclparse acme acosf acosh acoshf acoshl acosl acquires acquisitions acted
adamian adamic adamk adamson adao adaptability adaptor addentry addington addmntent addpartial addrdnvalues addrlen addseverity adele adinarayana adipiscing
adjtime adjtimex administering admittedly admitting adremap adriana adriano adrianorg advancements adverb adversaries advertises advisedly advocacy advocating
adwaita aelmahmoudy aenter aetheryx aevum aexit affine affirmation affirmed afifi afindic aforesaid afoul afraid africa afterasyncid afternoon afterpromise
agbakpem agentdestroy aggfuncs aggspec agiani agoric agranov agrawal agruen agustin ahoy aifc aimed ainv aiocb airing aistleitner aivo ajay ajruli akbarkhon
akheron akima akimoto akio akitsu akpm akram akutsu alain alameda alas albao albright aldo aleix aleixpol aleksa aleksandr ales alexahdp alexamder alexbostock
alexbs alexm alexzherdev algorithmical algos algs aliaspath alien alignof aliqua alist alkagar alle alleged alljson allman allotted almanzar almattar alnum
alocation alohaglenn alphanumerals alphanumerics alphasort altchars alteholz altepeter alteration alternated altho althome altri aluminium alves alvestrand
alyssaq alyx amanieu amanuel amaro amazing ambigous ambrosioni ameling amends amer amery amie amila amiri amouyal amphitheatre amplifications ampornaramveth
anachronistic analogues analogy analyser analysing analytic analyzers anchika andersk andesen andiemontoyeah ando andrango andreu andreysoktoev andriano
andrius andsch anentropic angelakos angov angular angus aniketshukla anilson ankita annie annonymous annotationlib annoyance annoys anon anonymization
anonymize anothertest ansidecl ansuz anthology anticipated antiderivative antitonic antivirus antonin antono antony antti anuj anupama apachelogger aparicio
apeltop apestaart apinames apitest apollo apologize apoorvanand apparmor appearances apperson apples appliance appmetrics appnote appout approximations
apsangi aptsources aquire arafat aras arbor arborist archana archiver arcname arcnmx ardel argcomplete argentina argmatch argued argz arian arie arkadiy
arkadiyt arkerone armies armiros armscii arnoldi arnon arose aroyan arptables arranz arrayprint arrayref arrayterator arruda arseneau arslan arthanareeswaran
arthropod arts artsci aryung asdf asdfghjkl asfortranarray ashleysimpson ashton asim asinf asinh asinhf asinhl asinl askpass aspiring asserion assertokvalue
assertthrowsfn assessed assignable assignee assing assuring astals astaro asthana astro asyc asymmetry asymptote asyncendevent asyncstartevent asyncwrap atanf
atanh atanhf atanhl atanl atashian ated atler atmark atof atoi atoq atsec attdecl attentive attias attlist attosecond attractor attrspec atudel aubrey
auckland audiences auditd auditlog auffer auger augmenting augop augtarget augustin austria autem authenticating authinfo authorizing autoable autobuild
autoca autocorrection autofit autofix autogroup autoincrement automata autore autorebase autoreset autoridad autosave autospec autostrip autovivify avalues
aviva avulapati awry axvm azeezullah azofeifa baabc bable backgroundimage backhouse backlogs backreference backtracks badalic bagder bagge baghdasaryan bagobj
bajtos bakos balakrishna balancers baldwin balloon balloy baltics baltimore bamber bamberg banks bannister barbarous barfing barfs bargaining barger barinov
baris barker barlaan barrett barriers bartek barthwal bartlomiej baruchel basak basetemp basetype bashisms bashurov basile basit bastardised bath batteries
battersby baugh bautista bavail bayazidi bazaar bcmp bcopy bdeflate bdfdrivr bdferror bdflib bdflush bead bean beanalby beat becho beckett beckman beef beetle
beforeasyncid beforepromise begintitle begs begum behera behnam beingessner bekman belaifa belatedly belcher belief beller belt benas benches benchmarkers
benchs bendall bengen benitez beos berala berenblit berge bernal bernaldo bernardo bernat bero berra berrini bessel bestiejs bestrelpath bevand bfree
bgallmeister bhalla bigend bigobj bigot bigquery bihlmeyer bincount bindtag binfmts binner bintao birthdate bisects bitbegin bitflags bitmasks bitorder
bitplanet bitrate bitrot bitset bitterly bitty bitworking bizarre bjoerkelund bjorkholm bkoz blackmesatech blaine blair blakehall blamed blanch bland
blankboundary blast blazing blead blei blend blends blinker blklocs bloat blocker blockingly blockmanager blockquotes blocky blow blueoakcouncil bluss blyz
boats bobadilla bogdan bogusly boil boilerplates bolder bolet bolsterlee bolts boltz bomb bond bones boneskull bonggi bons bootparam bootstraps borenius
borgerson boris boron bosselaers botelho botella botvin bounced bounces boundless bourcier bourgois boutell bower boxing boxplots bplist bprint bracked
brackety braden brainhub branched branchname brandchecks brands brandt brant braswell braun brauner braydon breakpionts brefs breiman breitenlohner brekenfeld
brendanashworth brendon brenith brenner bretterklieber brettkiefer brewster brice brick brillout brink brinkhoff brix brodie brodsky broekema brook brossard
brownman brunetti bruni brunner bruyne bryon brzozowski bsearch bsize bsnet bstring btowc btree btreefuncs bucci buchanan bucio bucksch buddenhagen bufbuffer
bufcomparetarget bufentries buffe buffillvalue bufindexofvalue bufkeys buflength bufslicestart bufvalues bugtrack buhacoff buildbot buildbots buildno
buildroot buildsystem buildsystems bujak bulletin bullotta bullwhip bumps bundler burda bureau burfoot burk burmese burmesedict busoli bust busybox butter
buttondown buttonup buty buzzotta bwalton byram bytecodes bytelen bytesliteral byteswap byxxx bztar cabot cabs cabsf cabsl cacerts cacheflush cacholong cacos
cacosf cacosh cacoshf cacoshl cacosl cactus cactysman cadata cadence caeen cager cahalan calcurco calebboyd calib callgraph callon callspec calltips
calltracker calm calum camantigue camargo camelcase camillo camilo campagna campinho campos camuffo canonicalised cantarell cantelon cantor caolan capget
capik capitalizations capitalizing capitlaztion caplog capped capset capsules captions caramba carbajo carcaci cards cardwell carg cargf cargl carole carson
carterbancroft carthew casefold casefolded casefolding casestudies casie casin casinf casinh casinhf casinhl casinl casper castillo castle caswell catalina
cataloging catamount catan catanf catanh catanhf catanhl catanl catclose categorization categorizing cater cathebras catopen catwoman caulfield causal
causality cautionary cavalier cavallari cavalli cavity cavium cbinfo cbor cbrt cbrtf cbrtl cccccc cccii ccedil cciss ccontent ccos ccosf ccosh ccoshf ccoshl
ccosl cctxt cdecl cdef cdefs cdiff cdouble ceasing ceccarelli ceelen ceilf ceill celorio celsius celtics cent centering centos centralizing cern certchain
certficate certificacion certify cervin ceschi cevans cexp cexpf cexpl cffi cfgetispeed cfgetospeed cfmakeraw cfree cfrg cfsetispeed cfsetospeed cfsetspeed
cgifaq cgroup chage chaitanya chajdas chakra chakraborty chalupa chandra changeable changehat changelist changesets chaotic chapman charactes charalampos
charclass charhndl chari charname charnames chasen chastain chatfield chaturvedi chauhan chaulet chcp cheaper cheapest cheat cheating chebab chebder chebfit
chebint chebweight checkbuttons checksumming cheetah cheetahify chelmsford chema cheney chenged chexiongsheng cheyenne chiaki chinedu chineeze ching chinmoy
chisnall chksum chktrcmp chlorine chocolate chocolatey choise cholesky chon chonka chougule chow chowdhurian chowksey chrisforrette chriskempson christina
christy chrominance chui chunky chunyang church chwalba ciabot cimagf cimagl ciphertexts cipherupdatedata circleq circumvention cirrus citerefentry citgez
ciucci civil civilized cjdict cjkv cjkvinfo claiming clakech clap clarence classdef classical classpathx classworlds claudiorodriguez clayton cleaness
clearenv clearerr clement clewell cliff clifford climbing clinton clips cllang cloak clog clogf clogl closebracket closedir closelog cloth club cluer clump
clusterforkenv clusterisprimary clustersettings clutch cmnt cmph cname cntrl coady coarser cobbled cockerhan codecname codegen codeline codeloc codemod
codemods codings codippily codreanu coercive coffeescript cohaesio coin colab colaborators cold colliding colloquialism colnames colom colormaps colormodel
colornames colortriples colvin comanescu comfortaa comm commandchars commencement commentchar commenting commissioned committees communicates compabile
comparably compartment compensate compensi compield compilable completekey complications complied compositing compromising compsoc comput computable
concatenator conceived concentration concluded condensation conditionalized condlist conectado configuation configurability configurei confir confstr confuses
congestion conj conjf conjl conjugated connolly conover conserved consoletimelabel consolidation consternation constistency constituencies constructive consts
cont contacting contaminating contentful contentless contentrating contentype contextifies contibuting contracting contractual contradictory contrasts
contravariant contravene contributi controversial contructor conventionalized conventionally conveyance conveys convincing convolutions cooked cookielib
cooking cooley coord coordlist copiable coprocessor copycommit copyfile copysign copysignf copysignl corba corcoran cord cordasco coreservices corgatelli
corge corman cormen cornacchia cornelius cornelssen corona corpora corporate correcly corresdponging correspdonding corret cortez cory cosf cosh coshf coshl
cosl cotangent cotin cotton couder countermanded coupled cousins coverdir coverett cowan cowper cozy cplint cpow cpowf cpowl cproj cprojf cprojl crack crap
crasher crawl crcc crealf creall createcount creationdate creedon creisle crept creutzig crippling cristau criticism croc crossbeam crow crowley crozet
cruelty crunchy crutcher crux cryptlib cryptokey cryptokeyusages cryptology cryptopro cryptosubtle csin csinf csingle csinh csinhf csinhl csinl csqrt csqrtf
csqrtl ctan ctanf ctanh ctanhf ctanhl ctanl ctermid ctors ctxcsn ctxtdoc ctxtflags ctxtnode cubically cubs cuffer cupertino curated cureent curlm curpad curr
curran cursed cuserid customisation cutler cuva cvetko cwru cxreg cyberelk cybernetic cybertrust cyeoh cyphar cyrill cyrille cyrillics czyborra daddr
daemonising dagobert dagolden daguerre daigo daimi dajobe dalgaard dalvik damercer damjan damm damned dams dance daniyal dans danshu dante danu daoming
daomingq dapena darkstar dart darts dascalescu daschevici datadog dataloader datamorph datanerds datanode datasize dateoffset datestamp datetimestamp dautelle
davi davidge davidr davisjam davison davkor daware dawes daynum dayton dbachko dbkxmlcatalog dbopen dbxml dcharbonnier deactivated deadlocking deakin
debchange debianutils debootstrap debt debuggee debuginfod decadent deceiving deciphered deckard declension declines declining decodable decodings
deconstructing decorates decorations decorative decouple decoupled decree dedup dedupe deepen deepspeed deepti definitively defparameter defun degenbaev
degradations degrades degtyarev deindent deindented dejon dejus delahaye delapouite delchev deletable deleteall delian delimits delimitting delims delimtter
delint delurk deluser delvare demanding demote demultiplexer denies denizens denker deno denoising denominated denormals denylist deokjinkim deoptimizations
deopts departures dependancies dependence dependently deraadt dereferences derevianchenko deriv desai desaturated descamps describename descriptiveness deser
designators desnoyers desolation despair desperation dessert destined destroyasyncid destructing destructive destructively detachable detailled detailyang
determinable determinism detlef detract deutsche deutscher devanagari devecchi developerworks developped develops deverick devi devicetree devil devnexen
devost devpts dexter dexterleng dfile dflt dgrams dguo dhennin dhima diacritical dialogue dialup dichiarazioni diet diffcore differenced differencer difflib
diffnew difftime diffusers digestmod digikod digip digitize digitpart digraph digs digulla dilly diminished dimitroulakis dinesh dingbats dinu dinwoodie
diosney dircmp dire directcolor directional directorys dired dirhandle dirmode dirnames dirstat dirsvcs dirtiness disappearance disassembled disassociate
disassociated discontiguous discontinued discord discount discoverability discrepancies discretized discriminate discriminating discriminatory discs
dismissive disparity displayable disposed disposes disposing dispositions disregarding disruptive distorted distproc distraction distressed disused dittmann
dive diverge divergence divergent divisional divya dixit dkuug dladdr dlclose dlinfo dllexport dllimport dlloads dlmopen dlpack dlsym dlvsym dmetaphone dmitri
dmlc dnat dncache dnreverse dnsgetservers dnsreverseip doap dobey docfd doclist docman doctag doctypes docuemnt docuemtns documentat dodev doenges doesnt
dolan dolore dolzhenko domainaddemitter domainexit domelevo domexception dominate dominated dominikeinkemmer dominykas donahue donating donggeon donnelly
donovan dooteo dotenv dotfile dotzlib doubleunderline doubtful douglass doulcet dove downcase downcasting downgrading downloader downsampling dozens dpaulino
dracula dragged dramatization drank drasner draszik drat drawback drazen drem dremf dreml dressel drewry drexler dreyfus dries dropout drownattack druotic
drwxr dstoff dston dtest dtors dtsen dtstart duaconf dubious dublication duchesne dudka duempel duktape dumas dumbreck dunavan dunkel dunnavant duplocale dups
duracef dusan dwelling dwitte dwzone dyanmic dyas dyatlov dylib dylson dyngroup dynlist dyork dysize dziumanenko eaccess eacute eaddrinuse eaglescrag earnie
earthian eases eastward eastwood easytrieve eating eavesdroppers ebickle ebpf ebtables echoes eckhardt ecvt edata edelbrock eden edgarzapeka edgecase edimitro
editting educated eecs eeeeec eeeeff eerik efae effectless efficios efimov egge eichwalder eiffel eigenvector eisentraut eisinger eiusmod ejecting ekiuusi
elaborates elad eladkeyshawn eldecl electrical electronjs elementary elephant elfutils eliaz elided elisp elkins elle ellson elname elpi elsasser elsbrock
elseif elsir elvis emailing emanuelbuholzer embargo embark embarrassing embarrassingly emboldened embrey emde emelyanov emerged emergency emirgoren emmanouil
emotion emplace employs empties emscripten ename enchandler encipher enciphered enclosure encodung encr encyclopedia endaliasent endchars enddate endevent
endflag endfsent endgrent endhostent endl endmntent endnetent endnetgrent endobj endowed endprotoent endpwent endservent endspent endstream endswith endtitle
endttyent endusershell endutent endutxent endwith enero engage engineered engineers enhancingperf enormity enquire ensimag entersub envar environement envvars
envz epeden ephemeralkeyinfo epic epilog epilogue episode epita eprod epsneg equiv eran eranian erbose erfc erfcf erfcl erff erfl ergo eriol ermilov errctx
errorcode errorevent errorlevel errout errread errwrite errx escapee eskew eslintignore esmodules esperi espinosa esposito essehemy estoppel estream etbe
etchart eternity etest etext ethernet etiny etree eturn eudaimos eugen eugeniy euskalgnu evalbytes evaling evalled evaluators evandro evantorrie evdns evens
eventfd eversole evgsyr eviction evicts evident evidently evport excep excepted exceptiongroup excepts exchangeable exchanged excise excised excited exciting
excludelist execl execle execlp execption execv execve execveat exempted exhibits exitcode exitmsg exitstatus expended experts expf expirationdate expiring
explaination explainer explcit exposures expressive expressively exprinfo extant extempore extensibility extensioned extfunc extkeyusage extracount
extractable extractall extractions extraglobs extrapolation extremes eyeballing eyes ezhil fabi fabiano fabs fabsf fabsl facades faces fade fahrner failover
faisal fakeing falguniraina falsandtru fancontrol fangorn fanotify fanoulis fans fansworld fantom fare farsi farther fastcall fastfeat fasth fatahi fatahn
fatalerror fatally fattach faulthandler faure favored favors favoured favours fchmodat fchownat fcloseall fcndec fcndef fcrozat fcvt fdetach fdim fdimf fdiml
fdisk fearnley featured feclearexcept fedisableexcept fediuc feenableexcept fegetenv fegetexcept fegetexceptflag fegetround feholdexcept feltman feminine
fenlason fenv feraiseexcept ferdi fermium ferrando ferrier fesetenv fesetexceptflag fesetround fetestexcept feugy feupdateenv fexecve fext ffeeee ffitype
ffmpeg ffree ffsl ffsll fftfreq fgetc fgetgrent fgetpos fgetpwent fgetspent fgetwc fgetws fgetxattr ficarra fichier fichiers fictionalization fiddling
fidelity fift figuring filemodes filenamecat filenaming fileobject fileset filespec filestring filfre filho filler filterentry finance findable findall
findgrep finditer fingernails fingerpint fingerpointing finitef finitel finstad fipsinstall fipsmodule fira firmaprofesional firstfloor firstset fisker fitblk
fixe fixme fjau flasy flatnonzero flatter flerb flexbuffers flickering flickz flies flipping flist flistxattr floeter flooding floorf floorl flour flyweight
fmaf fmal fmaxf fmaxl fmemopen fminf fminl fmod fmodf fmodl fmtmsg foaf foldspaces fontname fooref footnote fopencookie forceful ford foresee forests forgery
forkpty formality formating formfeed formline formulate formulated forsberg fortunate forty fossies fotheringham fouces foun foundry foxman foxxyz fpathconf
fpclassify fpucw fputc fputwc fputws fragoso franc frances frankel freakmail freeaddrinfo freehostent freeifaddrs freemail freiberg frekui fremovexattr
freqstr frexpf frexpl frexx fribidi friction fried friendlier frightening frings frisch frivolously frmo frobenius frobnicator frodol frogs fromdesc
fromfunction fromlist frommi fromstring frontpage frony frowns frozendict frydrych fsaccesssyncpath fschmodpath fschownpath fscopyfilesrc fseeko fsetpos
fsetxattr fsfstatfd fsftruncatefd fsfutimesfd fslstatpath fslutimespath fsmkdirpath fsmkdtempprefix fsopendirpath fspath fspromises fspromisesrmpath fsrc
fsreadfilepath fsreadvfd fsrealpathpath fsrmdirpath fsrmpath fsrmsyncpath fsstatfspath fstatvfs fsutimespath fswatch fswatchfilename fswritevfd ftbase ftcid
ftell ftello fterrors ftgxval ftime ftinspect ftlzw ftmac ftok ftoldmac ftpatent ftps ftpusers ftrandom ftrfork ftrylockfile ftsdf ftsvg ftzconf ftzopen
fuentes fulfils fullwidth fulton fumiya funcargs funcsynopsis funcy funda funes funlockfile funman funs funtion funzip furqan furthest furutaka fuses futex
futhark futher futimens futimesat futureproofing fuzzystrmatch fweimer fwide fwprintf gabarro gagandeep gagne galambosi galina gallery gallmeister gammaf
gammal ganguly ganil garantee garanzie garbee garbled garfield garg garrik gascon gasior gasp gated gatti gautier gawk gazit gblender gbusey gced gcvt gdccwxx
gdoc geared gediminas geert gehrcke geirha geisendo geisler geiss gemm generalizations generalizes generations genitive gens gentes genus georget georgia
geraldo geraskin gergely gergo gerk getaliasbyname getaliasent getargv getargvalues getchar getconf getconnections getdata getdents getdirentries getdn
getdomainname getdtablesize getent getentropy getentry getenv getfield getfsent getfsfile getfsspec getgrent getgrgid getgrouplist gethostbyaddr gethostbyname
gethostid gethostname getifaddrs getipnodebyaddr getipnodebyname getloadavg getlogin getmask getmaskarray getmntent getmsg getnetbyaddr getnetbyname getnetent
getnetgrent getnodeversion getpgid getpid getpmsg getppid getpriority getprotobyname getprotobynumber getprotoent getpw getpwent getresgid getresuid getrlimit
getrusage getservbyname getservbyport getservent getset getsid getspent getspnam getstate getstringwidth gettid getttyent getttynam getuai getunwind
getusershell getutent getutid getutline getutmp getutmpx getutxent getutxid getutxline getvalues getw getwc getwchar getwd getxattr gflags gforth ggml
ghebreweldi ghostwriters giammarchi gianni gibbons giffunip gigih gilad gilbertson gill gino gioele giora giorgos giraud girepository giri giscanner
giscannermodule gitattribute gitlinks gitmodules gittutorial giulio gladkov glasser gleam globalest globalization globfree globvar glotfelty glthread gnocchi
gnupload goat goatley godbolt goel goforth gohri goirand golda goldberg golde goldmine goldsborough goldschmidt goldwyn golemon goli golo golovin golub
golubev gomes gonsalves gonthier gonzalo goodness googleapis gorbachev goreportcard gorman gortmaker gosu gotparents gotthard goulding gourd govind gowdy
goyal gozalishvili gozman gpasswd gpgv grabbag grabbed gradle gradually graduated graduating graeme gramian grammatically grammer grandfathered graphemes
graphing graphql gratton grave graves graydon grbeos grdevice greediness greef greenfield greenleaf greet grenoble gresnel greyed greyson gridsize grieco
griffin grigoriy grimrose grmac grny grobjs groening grosse grosso grosspietsch groupcache groupname grswizzle grtypes gruber grulich grunau grushinskiy
gryniewicz grzesik gsettings gsignal gssacl gtime gtty guangcong gubblebum guertin guice guilhem guinea guix gultopu gumbel guranteed gurfinkel gurgunday
gurtovoy guttsait guyomarch guzhizhou gwer gxvalid gxvfgen gypfile gyptest gzappend gzguts gzjoin gzlist gznorm gzopen gzread gztar haber hachimi hackbunny
hackish hackman hacky hackzzila hadi hadis haefliger haejin hafiz haines hairiest hajnoczi hakan halatsis hall hallenberg halliday hallion hallon halting
halts halushka halves hameleon haml hammacher hamon hamwala hana handbook handlebars handleless handlescope handlings handsets handshakedone handshaking
handwritten hangup hangzhou hanke hankins happier hardcoding hardcore hardest hardin hardlinking hardwiring harendra haresign hargobind harlow harmonic
harries harshil hart hartgers hartig hartley hasan hasbullah hasegawa hashables hashchar hashrefs hashtables hashtag hasitzka hasmntopt hassaanp hast
haubenwallner haugh havvy hawes hawley haxe hayrapetyan hayward hazelwood hcreate hdestroy hdev headed headen headline headp headrev heappush heaps heapsort
heart hedeland hedenfalk heeeunkimmm hefangshi heights heikki heinrich heir heisler heisterkamp heitman helgason hellenic hellman helloooo hellug helsinki
hemberger henadzi henceforth hendrik henning hentai hereto hermcompanion hermefit hermeline hermeroots hermes hermeweight hermfit hermgauss hermline hermroots
hernaeus hernstig heroku herrington herror hettinger heuristically hevanet hexagon hexagonal heycam hfft hical hicks hideaki hidetip hiearchy hier hiertype
highlab highlighters highway higino hilarides hilla himadri himadriganguly hippo hirabhullar hisada hisham histogramdd hkps hmacupdatedata hmmm hnaulet hndl
hoare hodgskiss hodgson hoehn hofmann hogweed hohutkin hoist hoisted hoisting hojland hollandsworth hollow holmes holschuh holy holz homme homogeneity
homosaur honoured hoof hoogeveen hoohah hooking hookwrappers hoped hopes hopkins horal horihiro horkan horn horrific hostcheck hostmask hostmaster houmani
hourihane household houses houssem howtos hpsa hrishikesh hrvoje hsearch hsiao hsys htmldir htmldocs htons htop httpclient httpglobalagent httpwg huachao
hudec hukkinen hultman humanwebpl hummelink hunt hussaina huszagh hutchings hvco hveldstra hwaisiu hyatt hydrogen hynek hyperair hypergeometric hyperion
hyperref hypotf hypotl iandrc iano ibrahim iccjpeg ices iconvconfig icudata identd identfilter idleberg idness idris idrlogin idtest ietf iexp iface
ignoredirs igrishin ihaohu ihfft ihnat iinfo ilarion iliad illegalproto illescas illiad illig illusion illustrating ilogb ilogbf ilogbl ilyas imagelib
imagination imagnumber imatvieiev imaxabs imaxdiv imbricated imitates immaterial immprove immunity immunix impasse impending imperatively impleemntation
implem implementi implicating implicits imporove importances importhook importmeta importmetaurl impossibility impracticable imputed inadvisable inanimate
inappropriately incept incididunt incl inclined includible inclusively incomparable incpaths incubator indemnification indemnified indention indeterminacy
indian indicative indicatoron indice indics indomie indranil indrek inducement inefficiency inequalities inetorgperson infback inferences infinitum inflating
inflation inflecting inflection inflectional inflections influencing informatica infstr ingenito ingholt ingo ingredient inherrently inialization inifile
initailized initialcolor initialnames initiator initiatves initpromise initramfs initstate injects inkstain inlinable inlineable innetgr inokawa inoperative
inputrc inputted inputting inquiries inrewrite insb insecable insensitivity insidious insl inspectorclose insque instantaneous instantiations institutes
institution instruc instruments insw integrators intelligence intepreted interal intercalary interception interceptors interconverted intergraph interim
interlace interlacing internalize internationalize interoperable interpolates interpolator interpretations intersecting intimidating introdution
introspectable introspecting intrusive inue inum invalidcmd invalidcontinue invalidly inventors inverses invertible investigations investing invite invited
invocant iobuf iodef iodev iomanip iomenu ioperm iopl iovs ipadx ipady iptunnel irakli ircs irene irish irls irrational irrefutable irremediably iruserok
iryna isache isascii isastream isblank ischroot isclose iscntrl iscomplex isdale isdst iseki isfdtype isgraph isgreater isgreaterequal ishell ishii isinff
isinfl isjunk islands isless islessequal islessgreater isnanf isnanl isneginf isnogud isnormal isobel isomorphic isomorphically isomorphism isposinf ispunct
israel israt isrealobj isrequired issuers istead istinson isunordered iswalnum iswalpha iswblank iswcntrl iswctype iswdigit iswgraph iswlower iswprint
iswpunct iswspace iswupper iswxdigit isxdigit isync itah itch itemized itemset iterparsing ithreads itimerspec itname itoa itokens ittapi itty ivars iwyu
jaccard jackelin jacquerye jacques jade jadhav jaeger jaggy jahn jail jaime jalan jalis jamar jamen jameson jane janet jangid janis jannis janriemer jansa
jansons jaro jaromir jarpath jarrett jarring jarvinen jashkenas jaspal jasti javaopts javascripts javawrapper javax jawnsy jaxyz jayamanne jayasankar jayden
jayson jazelly jazzfree jcapik jcristau jdong jedireza jeena jelloween jeni jeny jeremie jess jethmalani jeyanthinath jfleck jgrulich jhbuild jiahao jiajie
jian jiangplus jianmei jianru jichan jiho jing jinks jinlabs jiri jitless jitterentropy jivsov jizu jkeenan jklepatch jlvivero jmmv jnareb joanne joaocgreis
jobala jodat johab johansson johnp johns jointly jong jonny joris josef josephleon jouhier jour jovan joye jpadilla jpaulptr jpersson jrme jsapi jsdoccomment
jseagull jsonnet jstring juang jucke judicious juerg juergh juliangonggrijp julianjany julianne julie juliet junctions junfeng jungku jungkumseok juniper jury
justice justifiable justshiv jyotman kacar kacper kadam kadir kafka kaijanaho kail kaila kailash kalambay kalle kalray kalvoda kamagate kamath kana kanis
kanji kannan kanyawtech kapil kaplun kapor karema karlheg karol karp karson karypis kasatkin kasim kask kathryn kattchee kauffman kawasaki kayla kaznovac
kazuma kazushi kazuyoshi kbuchcik kbytes kchowksey kcmp keble keescook keeysnc kegel keisuke keita keksonoid kelemeng kellermann kelsey kempson kemsa
kenigbolo kenji kennethreitz keno kenshi kenza kenzo keras kermit kerrisk kerry keycode keycodes keyctl keydb keyids keypair keyservers keysets keyspec
keystrokes khali khalid khalifa khalsa khan khanna khiratkar khlynovskiy khovratovich kiatisevi kibbey kickstarts kiefer kienitz kieslich kikinskiy killers
killpg killtimer kilzer kimeiga kimown kindly kinesis kinkhorst kinnan kinney kinslow kipling kirillov kirschbaum kitaya kitty kivilinna kiwiirc kiyomizumia
kjahds kjetil kjetilho klammler klapper klasses klepatch klinghed klipper kloczek klogctl klogd klomp kloosterman kluge kluyver kmuto knapp kneilmann knott
knowledgeable knowledgecenter knuth knyszek kobel kobelb koki kokoyaya kolac kolar kolpackov kolumbus komivi konchada konieczny konkani konv koppers kopylash
korbar korczynski kore korovkin kosa kosak kosnik kostro kothapalli kotlin kozelka kozlov kpathsea kreeger kresimirfranin krishnamoorthy kronquist krutko
ktistakis kubota kuin kuivinen kulev kuliavas kumarrishav kunda kuosmanen kuroljov kusto kuvatov kuzmenko kuzmin kuzminsky kwok kwonlyargs kylix labelanchor
labelwidget laboissiere labore lachler lacurie laddr lafuente lagcompanion lagerwall lagfit laggauss lagline lagroots lags laino lakatostamas lakech lalonde
lamp lamse landden landlock landmark lange langfeldt langille langname langstraat lankester laodict laplace lapo lara largepage largs larryhaja lashley
lastbind lastest lastimosa lastname lasttext lasttsize lasttuse latvian laughs launchable laursen lavin lawsuits laying layton layzell lazarev lazlojuly lber
lcfirst lconv ldapc ldapcompare ldapdelete ldaperr ldapexop ldapmodify ldapmodrdn ldappasswd ldapsearch ldapsync ldaptcl ldapurl ldapvc ldapwhoami ldexp
ldexpf ldexpl ldif ldifutil ldiv leakcheck leakfix leamas lebedev leca lede leder leeds lefkowitz lefteris leftness leftovers leftward legalcode legder
legible legint legweight lehtinen leidegren lekova lelli lemanschik lemon lena leng lennion lenvin lerc lesson lest leszczynski levanov levelname levsoroka
levsthings lexed lexemes lexicals lfind lgamma lgammaf lgammal lgetxattr lgtm liakhov lian libapparmor libary libaudit libcbor libcpu libdbus libdir libdl
libdm libdw libdwfl libebl libelf libera libero liberty libfakeroot libgdome libiconv libified libifying libintl libjoin liblber liblist liblmdb liblunicode
liblutil libmagic libnettle libnftables libnsl libnurbs libout libpipeline libplatform libproc libray libreadline librewrite libsemanage libsensors libsvm
libtabe libtoolize libvirt libxcrypt libxsltclass libyaml libyuv licenseing licensure licenza lifelogs lifo lightbulb lightlink likhter lima lina lindhorst
linearization linearize linenos linenum linenumbers lineterm lingle lingua linkat linkgit linkhood lintian linuxbe linuxpr lira lirc lisi listxattr litcoffee
littauer litvin liusi liviu lkey llabs lldiv llistxattr llrint llrintf llrintl llround llroundf llroundl llseek lmdb loadurl loan lobor localedef localrev
locomotion logarithmic logb logbf logbl logf logfile logica logl lognormal logwtmp lohit lohmann lokier lolwat lombardo longdouble longhand longlist
longrightarrow longva lookaround lookarounds loong loopish lora loreto loris lourida lowers lpha lremovexattr lrint lrintf lrintl lround lroundf lroundl lrowe
lsearch lsetxattr lsuffix ltgt luan luau lucasg lucena luciano ludiro luebeck lukasevych lunde lundibundi luntke lurie lvalues lynch lzop mabry machep
machinary mackerras macula madflow madhavan madhulika mageia magenta maggie magna maguire mahendra mahne mahotkin mailinglist mailrc mails maingui mainland
mains maintainance majordomo makecontext makedev makemaker makeover mako makosa maksimov malconfigured malformation malfunctioning mallinfo mallopt malone
malphettes malte maltese malyschkin malyy mamatha mandarin mandelberg mandelbrot mandersloot mandir mandrake mandrichenko mangling manifypods maniread manowar
manufacturers manylinux manywrites maple marat marescotti maret mariano marion mariscal mariusz marja markdowns marketplace markins marples marriott marschall
marshaller marshalling martii marton maruf marz marzonie masarati masato masatoshi masculine mashrab masochistic massar massimo mastering matchin mateo
materialising materially mathematic matherr mathewson mathforum mathiasbynens mathis mathur matijagaspar matin maton matrixmultiply matte mattila matzavinos
maurya maxbuffer maxexp maxfield maxime maxlevels maybes mbfunc mblen mbnet mboxrd mbrlen mbsinit mbslen mbsnrtowcs mbsrtowcs mbsstr mbstowcs mbsync mbtowc
mbuiter mcheck mckinstry mclasen mcseshu mdaum mdays mdfilter mdiff measurable mebibytes mechanims mechanix medina medini meek meelad mees megatron meghana
mehan meinen meinhardt meixome melez melo memalign membarrier memberof memccpy memcheck memchr memfrob memleak memoizes memops memorandum memusage
memusagestat mendonca mentally mentionning mentor mercenaries mercifully mergebase merger merkys meshcheryakov messageerror messing metainformation metal
metaparadigm metaphoric metaphors metastore metcalfe meteor methodname methodresponse methody metonym mewtwo meya mfrance mget mhoffman michaelis michele
michelsen michihiro mick mickael microchip microsemi middot midend midl migrations mihail mikhalev mileage milham milla millennium millionth milton
mimetostring mimicking mincore mindful mindrot miner minexp minheap miniature minifying minilla minilop minimise minimist minix minizip minttl minuend minuk
minuscule minya miod miodrag mirrored mirroring misalignment mischkulnig miscs misdesigned mises misestimation misformed misguided mishra misinterpreting
mislabeled misnomer misparse mispasting misprint misspelling misspelt misterpoe misty mistyping misunderstanding misusage mitar mitchum mitigating mitigations
mitsuo mittal mkdcodecache mkdirat mkdirp mkdorff mkfifoat mkinstalldirs mknodat mknyszek mkostemp mkostemps mkstemps mktag mkuhn mlflow mlgetopt mlock
mlockall mmapped mmisiarek mocker mockmethodobject modems moderately modernise modernizing modff modfl modifcation modname modpending modrdn modulechildren
moduleid moffat moffett mohammad mohit mohsen mojo mokhammad mokhin mold mollenhauer monaco monesi monetary monfort monge moni moniker monkeypatched
monkeypatches monks monochrome monolithic monospaced monotone monroy monte montserrat monty moogen morally mordy morel mornfall morning morphology morsel
mortal mortem morton morty morus mosel mota motaal motives mountain mountpoint moura moutte moveaxis movementarian movements moyogo mozhe mpfr mpih mpitests
mpool mprobe mprovement mput mremap mrgorbo mrityunjoy mroth mrowiec mrsam msctrl msgctl msgget msgop msgs mskala msmichellegar msvcc msvcrt msvs msync msys
mtest muey mugurel muhammad muhsin mujtaba mukherjee mulitple multicasting multicolumns multihop multilevel multimodal multindex multiplications multipurpose
multithreading multitude munged munla munlock munlockall munmap muntrace mupole murtaza musa muscat muscle musllinux mustache muto mutsumi mutta muzafar mvoid
mxnet myaddon myalloc myexample myfree myinternet myla myobject mypack mypen myproto myprove mysterious mystuff mytable myth mzucker naaman nadarajah nadya
nagayasu nagayasus nagaysau naik nakai nakashima namedobject nameless namespce namit nandyala nanf nanl nanno nanstr nanxiongchao naojirou naoki naortedgi
naptr nara narasimha narcisa narebski narrows narwhal nataly nathanael nathias natsort nava navigability navigating nayana nazaryev nbaz nbparams ncld ncols
nconsectetur ndandali ndapi ndpointer nearbyint nearbyintf nearbyintl nearing necessitates neehar negep negi neginf neglect negotiations neighbor neighbouring
neitsch nekral nemerle nemeth neps neri neshat nessie netapp netbase netconnectpath netconnectport netexpress netheaven nethra neto netsoc nettofarah netware
neue neuf neumair nevill newfstatat newish newlocale newlocals newmask newname newparents newshape newsub newton newtype newvalue newver newvers nextafterf
nextafterl nextclient nextdown nextdownf nextdownl nextstep nexttoward nexttowardf nexttowardl nextup nextupf nextupl nfixedargs nfoo nftw ngoc ngroups nhoel
niall niceness nicknamed nicolle nicu niederer nika nikaes nikander nike nikki nikoladev niksic ning nion nishikawa nislib nisplus nisses nitfol nitin niya
niyas nizovtsev njunk nlargest nlink nllobera nlohmann nmake noble nobse noclobber nocorepack nodedownload nodeids nodelay nodeuser noelamac nofwayy nolik
nolint nologin nomeata nomenclature nominate nominating nominative nonblocking nonbreaking nonchar noncharacter noncompliance nonetheless nonexistant
nonexistence nonidentical nonnegativity nonostante nonpm nonreference nonspacing nonspecial nontrappable noperfctr nopreproc nops norayr nordered nordics
noresize normalise normalising normalperson normaluser normlzr northwestern nose nospam nostalgic nosuchlayer notarytool notdriveletter notifier notionally
nototalargs notree notto nowait nptl npts nread nslcd nsmallest nsname nssov nstepien nstrftime nsxml ntemiris ntempor ntohs ntotalargs nttdata nudge nuke
nuked numa numchildren numdata numerate numerators numified numlines nummpy numpydoc nunez nupur nurali nuts nutter nuxi nver nwafili nwin nwrapped nwritten
nyakhaychyk nyby nyorain oala oberoi obituary obiwac objected objecttype objfiles obligate oblosys obrezkov observances obtuse occupying occuring ocert octals
odem oder odin oesterreich offenses offerings officers officialized officials ofir ogni ognyan ohashi oilpan oject oktavianus olan oldfstat oldhunk oldlstat
oldmask oldolduname oldstat oldsub oldtype olduname olegas olek oleksii olivetti olszewski olysonek omander omer ommited onboard oncreate ondruch oneliner
oneshot onethird onge onion onlinepubs openbracket openjs openlog openssh openvz opere opnumber oppenheim oppose optimally optimisations optimised optimistic
optimizers opting optionality optionnal optionnally optionsdetached optlevel optopt optrees orandea oranges orchis orcus orderable orderedlist orderedness
oreader oreilly orgad organizationally orgname orients originale originator orinoco orta orthonormal ortiz osadl osax oscrypto osgood oslevel oslo ossi
ostream oswald othertest otsvg otubo otypes outb outcnt outdent outfp outl outlier outliving outname outperforms outsb outsl outsw outw outward outweighs
overdue overestimate overflown overlays overloadable overread overrode overrule overshoot oversight oversized overzealous ovflowd oviir owed owens ownerless
oxley oyler oyvindln paas pacman padilha padmanabhan pagani pagano pagectrl pageinspect pagure pahl paho paige paillard painless pairings palaniappan pallets
pallxk palmires pandey paneconfigure paned papadopoulos papaspyrou papered paprocki paradise paragonie paralleled parallelizable paramater parambir
parameterise parameterised parameterset parametrizing paranoia paranoid paraphrase paras paraschenko parashar parasitically pared parekh paridel parlance
parms parrelli parsearg parseargs parseinfo parsons particulars partner parzinski pasero pashev pasquale passably passwort pastak pastebin pastie pasumarthy
pasv patchable patchfile patelt pathconf pathinfo pathlength pathparsepath pathposix pathsep patrol pattara patten patterna paulauskas pauw pavageau paves
pavol pawlowski pawn pbcopy pbind pcache pcfdrivr pcfread pcfutil pclose pctxt peaks pecora pedagogy pedantic peekfd peel pekka pele peleh penalized pendown
pengjie pepper perfidy perfmonctl periapt periodical perky perlapi perlbrew perlbug perlcall perldata perlform perlhacktips perlhist perlipc perllocale
perlmod perlmodstyle perlmroapi perlnewmod perlobj perlop perlpunks perlre perlrebackslash perlrecharclass perlref perlrun perlsec perluniprops perlvar
perlvms perlxs perlxstut permuted perrat perusin pessimistic petar petere peterw peterwmwong peterz petka petkaantonov petkov pettersson pexpect peze
pezhmanparsaee pfeiffer pgcrypto pgrowlocks pgstattuple phased phcoder phenomenon phijohns philb philibert philipc phillipoux philosophy phisixersai phonetic
phonorecord phonorecords phptest phrasebook phrasebooks phukan pickers picklers picon pidora pidx piepmatz pierangelo pierson pieter pihlstrom piisang
pimterry pingpong pinho pinpad pins pinzon pioneered piotrowicz pitfalls pitrus pivoted pivoting pizarro pjson pkcs pkdecrypt pkeys pksign plackup plainer
plates platzer players pldd pleasant pletnev plugdev plurality pluralization plurals pmarchini pmount pngshim pobj pocket pocztarski podchecker poddar podpage
podzimek poet pohly pointee poisoning poisseau poissonnier pokorn polack polled polli polly polyfromroots polyitem polyroots polyvalfromroots pomerantsev pong
ponomarev pontonio pony poole poolmanager poon poorvitusam pooya poriazov pork portal portibility portland portmap portugese posexplode poshak posixoptions
possessing possession possibilty postcommand postderef posth postman postorius postremoval potatoes potham potra potuzhnov pounds poutch powf powl poyraz
poznyakoff ppcle ppinfo ppolicy ppoll ppport pprinter praat prabu practises pragyan prajasakti prakash pranay prasanna pratik pratt prayag prcoess prctl
preadv prebuild prebuildify prebuilds precarious precedent precip precomp precompiling precompose precondition predate predetermined predicts preemptive pref
preface prefacing prefering prefilled preforming prelinking preparsing prependdir prepped preremoval presbrey presume presumes pretokenization prettier
prettiest prevails pricacy primality primaries primed primer printmsg prio prioritized priors prism priya priyank priyanka prize prng probert probings
processargv processconfig processeswithout procfile procter procuring productions profanity professional professionally progbits progga programmed progressbar
progressed proj projname proleptic prometheus proposes propset proptest prot protcol prototoype prototypal proxying przemyslaw pschiffe pselect pseudocolor
psiginfo psignal psuedo psychic ptar ptext ptjm ptree pubid publicizing pubring pubs pudding pulldom pump punit punitive punt purbey purelib purporting pusher
pushkal puskin putative putchar putgrent putil putmsg putpmsg putpwent putspent pututline pututxline putw putwc putwchar pvalloc pwconv pwdauth pwpattern
pwritev pyclbr pydistutils pyexpat pyfiles pyfisch pyfunc pymodeline pyobjc pyodide pyramid pyrepl pyrex pyte pyver pyxlsb pyxsltproc pyyaml qahiri qard qcut
qecvt qfcvt qgcvt qiangqiang qianyue qingyan qinjia qmail qrst qtext quadri qualification qualifying qualitymanifest qualname qualora quantified quantifying
quanto quarkslab quelltextlich quentin querna questa quickfix quinn quirk quirkster qunatize quopri quorum quotactl quotearg quuux qwertyuiop qwertzuiop
rachelnicole rackable radd radically radovanovic raemdonck ragnavan rahat rails rainabba raivis rajatk rajesh raku ralphson ramacher ramen ramesh ramm ramon
ramos rampin randall randn randombytes randomfill randomuuid rangadi rangelooij ranging rankings rantanen rantwijk raoof raozuzu rargs rasberry rased
rasterizer rates raut ravindra ravindran ravishankar rawend rawhide rawmemchr rawstart rayleigh razvanbh rbac rbalint rdate reactivate reactos reacts
readablemapfn readablepause readablepush readableresume readablestream readahead readback readble readies readin readpassphrase readrc readthedocs reak
realignment realise realistically realizing reallocate reallocations realname reals realtime realwakka reap reappearance reappears reapplying rearm
rearranging reassemble reassembly reattach reauth rebalancing rebooting rebrand recalculate recalculates recalled recallocarray recieve reciprocals recknagel
reclaim recno recognisable recomputes recomputing reconciled reconfiguring recordable rectangles rectify rection recurring recusion recvfrom recvmmsg recvmsg
recycled recycling redacted redeclare redelmeier redfern redferni redir redirrect redist redondo redownload redox redraw reducers redunant redundantly redux
reenabled reentry reestablish reevaluate reevaluated reexamination refaliasing refcounted refcounting refector refed refentry refined refiner refint
reflexivity reflink refnamediv reformats refpurpose refraining reftests regerror reget regfree reggi regional regisser registerin regluar rego regresson
rehashed reimplements reineke reiner reinject reinjection reinterpret reinterpreted reinvent reissue reiterate reizner rejectfont rejoins rekey rekindling
relabel relabeling relabelling relegate relieved relinquished relinquishing rell relocate relpath reluctantly remade remainderf remainderl remarks rembo remco
remediated remnants remoteauth remoteref removexattr remque remquo remquof remquol rems renameat renamer renardias renato renaud renderer renderers
renegotiations renew renker renormalization renoth reorders reorganization repacker repaired reparent reparse repertoire repertoiremap repertoires
repetitiveness replacelist replcae replstartoptions reportedly reporthook reposted reposts reprlib repro reprocess reprocessed reproducibly reproductions
reprojection reprs repurposing reqd reqt requestaborted requestauthority requestdestroyed requestenddata requestmethod requestor requiremain rerandomise
resave reschedules rescue resembling resende resent reserializing resigning reso respawn respectable responsereq responsesenddate restartop restfulclient
restrizioni resurrection resuse retbins rethinking rethrowing rethrows retr reusability revalidation revcount reveals reveman reversal revive revmax revp
rewinds rexec rfcs rfer rfind rgoldwyn rgoodwin rguyom rhalldearn rheault rhetorical rhino rhoslyn rhubarb riccardo richardc richer richmond ride ridiculously
rieken rienstra riftio rigel rijndael rijs rikapo rimas rintf rintl rios ripkens risoluzione ritchie ritz rlclose rlogin rluvaton rmse rndjent rndunix robbe
rober robertkowalski robey roblox roboto roch rocholl rockai rockarts rodger rodion rodney rodolfo rodrigues roeder rogertyang rogue rohit roles romuald
ronahi rooms rootless rosario rosaxny roschin rosenthal rossi rosslagerwall rossmann rosten rothkoff rothwell rouault roundf roundl roundup rousseau roussel
rownames roystgnr rpath rpcgen rpmbuild rpolli rresvport rrichard rrod rruleset rsuffix rsvg rtld rubikscraft rubin rubric rubys rudd rude rudenko rudi rudolf
runnning runoptions runsafe ruserok rusnak ruxandra rwlock rwmconf rwmdn rwmmap ryans rybak rytarowski ryuichi rzeszutek saad saadi saagar saavik sabari sadia
sadness saeed saenger safekeep safeseh sagar sagirk sago saha sait sajidul sakae saleem saleh salikhmetov salvaged salvo salzburg samborski sameer sames
samines sampler samshull samtools samyuktaprabhu sanctioned sander sang sanitised sanitizes sanlig sanou santana santosh santrach saout sapkin sara sarai
sarath sarge sarmiento sartrey sasdy sashes sasl saslauthz satimage satisfaction satoshi sauer saurabh savestack savetxt savi saxena sbind sbrk scabhi
scalarref scalate scalb scalbf scalbl scalbln scalblnf scalblnl scalbn scalbnf scalbnl scandir scandirat scannerlexer scannerparser scanners scarcely scarlet
scdoc schafer schedulers schenkelman scherer schick schievink schiffer schlenkrich schlereth schlyter schoenert schorn schottelius schraitle schramm schreijer
schuchardt schuech schulte schumaker schweda schweikert scored scorpio scovetta scrambled scrape scraped screenful scriptname scrolls scrubbed scrutiny
sctypes sdras seabrook seagetassetkey seamonkey seantcoyote searchlist searchpath searchphrase searcy seas season seat seattle sebastiano secant seccrypto
seclists sectigo sectioned securable securetty sedation seekdir seeluangsawat segv seidel seifert seishun selectimage selectmode selenic selfsigned seltzer
selvaraj semctl semget semiconductor semir semis semop semtimedop sendfile sendmmsg sendmsg sendto seok seonghoon seperated seperately seprated sequoia
serbinenko sercan serf seric serverlistening serverlistenpath serverlistenport servo sessionconnect setaliasent setattr setbuf setbuffer setcontext
setdomainname setfsent setfsgid setfsuid setgrent setgrid sethostent sethostid sethostname setimmediate setkey setlinebuf setlogmask setmntent setnetent
setnetgrent setns setpriority setprotoent setpwent setresgid setresuid setrlimit setservent setspent settimeofday settle settledpromise settles setttyent
setusershell setutent setutxent setvbuf setxattr seungha severing sexual sfeir sfeltman sfllaw sfnt sftp sgetmask sgetspent sgid sgreylyn shabi shachnev shade
shaded shader shahrabani shailesh shaisultanov shakil shakir shalvah shaman shane shaneh shanmugam shannon shao shapename sharkfisher sharon shastri shasum
shasums shatskiy shear shedmake shekhawat shelved shemsedinov shen shibukawa shiftjis shih shilov shindelar shinho shiva shivanth shiyas shmat shmctl shmdt
shmget shmop shoe shogun shohei shop shortens shortletter shouldn shovel shoveling showemail showlist showroot shrinkwrap shrits shrivastava shtool shubheksha
shunsuke siasl sichinava sidebottom sidestep sidwebworks sieder sifive sigaddset sigala sigaltstack sigandset sigblock sigdelset sigemptyset sigevent
sigfillset siggetmask sighandlers sighold sight sigignore sigil siginterrupt sigisemptyset sigismember siglongjmp sigmask signalfd signatured signbit signgam
significandf significandl signifying signoff signupdatedata signups sigorset sigpause sigpending sigqueue sigrelse sigreturn sigset sigsetjmp sigsetmask
sigsetops sigstack sigsuspend sigtimedwait sigval sigvec sigwait sigwaitinfo sigwyg silpa simbule simona simonds simonsen simos simper simplefilter simpleq
simplfied simutf sincosf sincosl sinf singhal singletons sinh sinhf sinhl sinica sinik sinkhaha sinl sint sitecustomize sitsofe sitter siunitx sivervik sixth
sizegrip sizehint skala skdltmxn skelother skelton skenqbx skibinski skil skipinitialspace skitt skjonsberg skog skylake slabinfo sladkey slant slap slapacl
slapadd slapauth slapcat slapcommon slapd slapdn slapi slapindex slapmodify slapo slappasswd slapschema slaptest slashed slate sleeping sleepycat slen slept
sliepen slist slogdet slominski slomo slovak slowing slurm smartpqi smarts smarty smarus smedegaard smereka smirnov smithy smitley smolenchuk smolin smooths
snapgear snapping snapshotting sneaky sniffed sniffing snook sntech snyder soar sobol sociomantic sockatmark socketbindport socketcall socketconnect
socketconnecting socketenddata socketpair socketpause socketresume socketserver sockfile sodhan sodium softcatala softint softwareag sokolov soldea solebox
solidity somestring sometest sometext sommer songofacandy sophia sore sortctrl sortfunc sortingi sota sott sourav sourcemap sourcepole sourcescanner spaillard
sparcs spare sparingly sparkassen sparkplug sparsification spatchcache speakeasy speaker spearce specializes specialness specifiable specificities specifiying
speedy spelvin spew spice spiceland spieler spigolon spill spinners spinning spite splain splitchars splitlines spoken sport springer sprinkles sprinzl sprof
spruce spufs sqrtf sqrtl squashes squidster sramacher srandom srclink sreepurna sscanf ssetmask ssignal ssleay sslkey sssvlv stab stabalize stabilized
stablility stably stacey stacktraces staikos stailq staite stalls standardizing stanish stanza startd starter startevent startfrom startxref starvation
starving starynkevitch statbuf staticcolor staticgray statistically statuscode statusmessage statvfs statx staying stayton stctrl stddef stdev stdios stealing
stefanha stefania stegun steinbach stelten stepien stepisnik stereo sticks stilted stime stipulated stodden stoeneberg stogner stogova stokingerl stooge
stopline stor stoutin stpecpy stpecpyx stpncpy stratification stratified strchrnul strcoll strcspn strdupa streak streamable streamlike strengthened strfmon
strfromd strfromf strfroml strfry stricten strictqual stringliteral stringparam stringr stringwise stripdir striped stripes strives strncat strncmp strndupa
stroeder strongtalk strpbrk strsignal strspn strtof strtok strtold strtoq strtouq structfield structname struktur strukturag strverscmp strxfrm stubstitutions
stucki studebaker studios stuffing stupidity stuttgart styledoc stylistically suauth subarr subcontinental subdevice subdiagonal subdivided subdividing
subdomain subdtypes subfield subforms subframe subg subgroup subheadings subhi subhransu subjected sublexers sublicence sublicensing submitters subn
subnetmask subnormals subordinateio subpart subpaths subppattern subpragma subprocessstderr subprocessstdio subra subrahmanya subramanyam subsampling
subscribes subscribing subscripting subsections subsidiaries substantiated subtasks subtlety subtrahend subversions subvert succession succumb suffixmassage
suid suidscript suitename sukhbaatar suleyman sumit summarization summarizing sunder sung sunset supelec supercookie superdiagonal supermodule supernet
superordinate superordinates superscripts superwoods supplant supplier suppored supposedly suppressible supress supriyo suraiyah surbhirjain suren surenb
suretec surez surprised survey susana susantruong sushil susie suspension sutangu sutter suyash svcid sverdrup svginterface svgtypes svgxval svipc svttcmap
svttglyf swab swagat swahili swallows swapaxes swapcontext swaplevel swapoff sweeter swenson swinburne swish switchover swprintf sylkat symbolfilter
symbolically symlinkat symposium syms syncfs synchronizer synchronizes synchronizing syncing syncrepl syncs synthesized syromyatnikov sysadmins sysid
syskonnect syspath sysroot systematically systemerror sysvipc syuhei szabgab szabo szakats szewczak szmarczak tabnanny tabulate tabulatedreams tabulation tact
tadao tadhg tadhgcreedon taggername tagunov taha tailq tainting takahiro takato takdeer tallied tama tamper taneli tanf tangible tangren tanhf tanhl tanl
tanuja tape taps tapx tardif targ targetlist targetname tarjei tars tartley taruishi taskcontext tatham tatsuo tatu tautschnig tavan taveras tavl tavmjong
tbreak tbroyer tcdrain tcflow tcflush tcgetattr tcgetpgrp tcgetsid tchenpan tchoupinax tcsendbreak tcsetpgrp tdelete tdestroy tdyas tearing tebbi techinical
technotes teco teeing tege teixeira tejbirsingh telenord telesec telia telldir telnetd tembel tembrechts tempering templated tempnam temporally temporariliy
tempted tenacity tended tene tenenbaum tensilica tensorinv tensorsolve tentatively teppeis tera teragram terance terminfo termio ternaries terpstra terrible
terrier territory testavl testcases testdir testharness testp testtavl testxslt testzlib tetelman tetragram texlive textasciitilde textwrap tfind tftp tgamma
tgammaf tgammal tgkill thangamabob thatclassname thecodrr thelady themez themself theobald theotime theraven therefor theriot thickness thijsschreijer
thlorenz thomasvoss thomlinson thomson thoughts thrashing threadpoolctl thrift thrysoee thuermann thumbing thunder thunderbird thursday tichonczuk ticker
ticki tidily tiebreak tierlist tiff tiffany tigert tijl tikotzky tiled timathon timcosta timegm timelocal timerclear timercmp timerisset timersub timesten
timestep timings timoshkov timruffles timur tired tiselice titlecase titus tjarda tkill tkorbar tkxmllint tkxsltproc tlsgetciphers tmpnam tmps tobewhatwewant
toboid tobyfarley toda todesc toerring tofile tokendef tokenise tokenizes tokensource toknum tokuhirom tolerating tolmasky tolnay tomatoes tomb tomeu tomfa
tomfoolery tomli toon topicalizer torgrim torne torres torrie totp tottokotkd toupper tour tourist tourists towctrans towlower towupper toyo tpanthera
tpurcell tqdm traceable tracer tracingchannel trackercallsfn trackers trackerverify trader trains trampling trampoline tranpose transactionally transcoded
transcoding transcript transferrable transitively transliterates translucent transpile transpiling transporting trasfer trashed traver traversables treadway
trebor treeish treemagic treetop trend trends tretkowski trevnorris trickey trickier tricoli trie triggs triglav trigonometry trigproc trionan triop triostr
tristate trixie trolle troublesome troughcolor trouv truetype trujillo truncf truncl truong trustcor truths tsabolov tsai tsarevich tsearch tsen tseries tsexp
tshemsedinov tsoy tstamp ttcmapc ttcolr ttext ttgxvar ttsbit ttsvg ttyname ttype ttyslot ttytype tuan tuffbizz tunnelled turbo tushar tutopia tutti tuxcall
tveit twalk twalljava twchn twist tyhicks tying typechars typechecking typedarray typeddict typeerror typeface typefix typeglob typeglobs typemaps typescript
typesetting typespec typst tyranny tyson tzafrir tzoe tzres tzstr ualarm ucdata ucgendat uclibc ucode uconn uconv ucpgba ucvlatin udbachk udiv udplite udppair
ueshin uffmann ugetrlimit ugultopu ukrainian ulan ulckpwdf ulisse umac umarov umatoma ument unaccompanied unadded unadvisable unalias unangst unannotated
unavoidably unblessed unblocked unbreaks unbuffer uncheck uncloneable unclutter uncollected uncomfortably uncomparable uncompr unconnected unconsciousness
unconventional uncorrupted uncounted uncurried undecodable undecoded undefinetively undefining undeprecate underbar underling underruns underspecified
undertaken undesired undetected undisplay uneditable unfamiliar unfixable unfolding ungetc ungetwc unices unichrome unicon unidiff unification uniformity
unifying uninformative uninitialised uninterpreted unintialized uniset unisoft unitializing unity univ universe unixbeard unixes unknowns unlockable unlocking
unlocks unmarshal unmarshalled unmarshaller unmarshalling unmasking unmasks unmatch unmodifiable unnest unobserved unpackings unpadded unpatched unpersisting
unpickleable unpiped unprintable unqualified unraisable unreal unrebased unredacted unreference unreferencing unregistering unreifiable unreliability
unresponsive unrevs unrewarding unsanitized unserializable unserialized unshare unshifting unsightly unsolicited unsortable unstripped untaint untestable
untgz untoward untraced untrapped untrustworthy unusually unverified unvis unweaken unweakened unwelcome upcasting updateable updatedb updwtmp updwtmpx uphold
uplink upshot upvote uranusjr urestubs urged urkade urlfetch urlhref urlsearch urltojson urltostring usecase usecomp usefixtures usefulinc usefully usegmt
uselessly uselib uselocale usercustomize userdata userfaultfd userinput usta ustar ustat ustpcpy utano utbm utbmstub utempter utilise utimensat utku utmpname
utmpx utmpxname uttampawar uusi uxntal uzlopak vacura vadoc vagaries vagrant vaguely vaibhav vaishno vakoc vales valgind validateport vallat valloc valsort
valters valueless vandry vann varables varankin variably variale variances varname varshavchik vasek vasicek vasseur vcbuildbat vcbuilt vcinstalldir vcsa
vctxt vdprintf vecdot vectorize veerathanabutr venkataraman venugopal verborgh verbous vercel verfaillie verge verheijen verifpal verifyupdatedata verlag
veronika verr verrx verschueren versioncheck versioneer verwaest vespa vested vestigial veth veto vetted vfat vfork vforks vfprintf vfscanf vfwprintf vgoyal
vhangup viability viateur vidya viero vigenere vighnesh vijayalakshmi vilner vinicius vintage violating violators virtualization virtuozzo virus visa viscii
vision visitors visits visualisation visualising visualized vitpavlenko vivek vladimer vladislav vladyslav vlasenko vlimit vlist vlvctrl vmoroz vmsperl
vmsplice vobj voicenet voilokov volgin volunteer volunteered voss vozza vpathlib vpgc vpodzime vprintf vratislav vreportf vscanf vserver vsprintf vsscanf
vstudio vswprintf vsyslog vtables vtimes vulns vuntz vuthi vuthichai vwarn vwarnx vwprintf vybiral vyper wabt wacky wadas wadelma wain waitid wakely walasek
wald waldorf wales walked walkers walls walrus walukiewicz wangzengdi wanna warcraft warmly warmup warnx warp warren warts wary washington watilde wave
wavelan wbond wbrack wcpcpy wcpncpy wcrtomb wcscasecmp wcscat wcschr wcscmp wcscpy wcscspn wcsdup wcslen wcsncasecmp wcsncat wcsncmp wcsncpy wcsnlen
wcsnrtombs wcspbrk wcsrchr wcsrtombs wcsspn wcsstr wcstoimax wcstok wcstombs wcstoumax wcswidth wctrans wctype weakened weakmap weakness weakrefable weakrefs
weaning webcast webcasting webencodings webidls webmessaging webp webpage webui wedgwood weekofyear weevers weigh weighing weijie weirdness weisshaus welcomes
welihinda weng wenjun wenning wenningplus werken wesselink wfile whatchanged whatis wheat wheelhouse whereabouts whiley whines whip whitebloom whitehouse
whitten wiberg wicg wich widatama widman widthxheight wielaard wiggy wijiji wildcarded wildebeest wilf wilford winbase wincred wind windres wine winfnt
winfonts wingo winner winsecur winston wintercg wired wiskunde witteveen wittmer wmemchr wmemcmp wmemcpy wmemmove wmempcpy wmemset woerkom wojdyr woken
wolczko wolf wolneykien wolpert wondering wonky woodburn woody worded wordexp wordfree wordings wordy workday workdir workerparentport workerworkerdata
workstations worldbroken wormer wprintf wrangling wraparound wren wressell wright writables writefile writen wrox wsgi wunsch wurde wuweiweiwu wwwroot wxcvbn
xandru xattr xcalloc xcde xcodebuild xcrun xcrypt xdecrypt xdelta xefimx xemul xencrypt xfailed xfrm xgetcwd xiaoyu xilinx xincludestyle xinrong xiph
xkbcommon xlabelsize xlibs xlocale xlsb xlsx xmax xmin xmlapp xmlcatalog xmldecl xmldsigverify xmlio xmllib xmlmem xnull xorgproto xperf xrealloc xrot xsbchen
xserver xslfaq xsltconfig xsltdebugger xsltrick xstrtol xstrtoul xsubs xtransport xugo xusers xxth xypron xztar yaari yakov yallop yamamura yamashita yamllint
yandex yankees yaqoob yaremtso yarnpkg yathamravali yearly yegorushkin yehiyam yelp yeoh yersen yhbt yitong yiyun ylabelsize ylonen yocto yogeshwar yohanan
yong yoram yosemite yoshfuji yoshimoto yoshioka yotamselementor younger yourfilter yourformatter yourlexer yourmodule yourselves yourstyle yozian ypclnt ypupd
yrot yubico yubin yuhanun yuichi yukihiro yuriettys yusuke yuya yylex zabarauskas zadehdolatabad zadoks zapping zaslavsky zcat zcbenz zeitlin zenburn zenity
zenz zeroeth zeroing zeta zezula zherdev zhmushan zigo zijlstra zilch zilla zimmerman zinosat zinser zinsou zipapp zipimport zipinfo zipnote zipping zipsplit
zirak ziskind ziyun zlibflushkind zombie zoned zongmin zoslib zoubin zougloub zseries zugschlus zutil zveno zvon zxcvbnm
""".split()
