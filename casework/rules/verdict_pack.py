"""The verdict cascade: ordered rules from the closing words of an opinion to one verdict phrase.

Rules that an earlier rule always forestalls are left out: 'an award is made'
anywhere in the text decides in the first block, so no later rule needs that
phrase; 'judgment is affirmed' never gets past the explicit judgments.
"""

from casework.rules.engine import rule

UNKNOWN_VERDICT = "Verdict Unknown"
_AMT = r"\$?([\d,]+(?:\.\d{2})?)"
_PAID = r"\$([\d,]+(?:\.\d{2})?)"
_GRANTED = {"label": "Award Granted (${amt})", "bare": "Award Granted"}


def _granted(*patterns: str, **options):
    return rule(_GRANTED["label"], *patterns, **{"bare": _GRANTED["bare"], **options})


# Fixed values from here on: phrases, windows, order and labels decide the result.
CLAIMS_QUICK = [
    rule(
        "Award Granted (${1})",
        r"award (?:is )?(?:made|hereby made) "
        r"(?:in the amount of |\saccordingly in the sum of )?" + _AMT,
    ),
    _granted("an award is made", amount="any"),
    rule("Award Denied", "refuse an award"),
    rule(
        "Settlement Ratified - Award Granted (${amt})",
        "ratified and confirmed",
        amount="any",
        bare="Settlement Ratified - Award Granted",
    ),
]

CLAIMS = [
    rule(
        "Award Denied",
        "refuses? to recommend an award",
        "claim for damage.*?is denied",
        "award is denied",
    ),
    _granted(
        "award is hereby recommended",
        r"award is\s*,?\s*therefore\s*,?\s*made",
        "award is accordingly made",
        r"award o[f]?\s*\$?[\d,]+ is made",
        "we are of opinion to.*?award",
        "award is made",
        window="tail_1500",
        amount="any",
    ),
    rule("Settlement - Award Recommended (${amt})", r"recommend.*?appropriation.*?" + _PAID, amount="any"),
]

END_TEMPLATES = [
    rule("Award Granted (${1})", r"entitled to an award of \$?([\d,]+)", window="tail_1500"),
    rule("Award Granted (${1})", r"an award for \$?([\d,]+) is just and proper", window="tail_1500"),
    rule("Award Granted (${1})", r"therefore award the claimant the sum of \$?([\d,]+)", window="tail_1500"),
    rule("Award Granted (${1})", r"should be paid him as damages.*?\$?([\d,]+)", window="tail_1500"),
    rule("Award Recommended (${1})", r"recommend an award.*?\$?([\d,]+)", window="tail_1500"),
    rule("Judgment for Plaintiff (${1})", r"judgment may enter that the plaintiff recover.*?damages of \$?([\d,]+)", window="tail_1500"),
    rule("Judgment for Plaintiff (${1})", r"judgment is rendered that the plaintiff recover.*?damages of \$?([\d,]+)", window="tail_1500"),
    rule("Judgment for Plaintiff (${1})", r"judgment may be entered that the plaintiff recover.*?damages of \$?([\d,]+)", window="tail_1500"),
    rule("Judgment for Plaintiff (Nominal Damages - $1.00)", "judgment for one dollar", window="tail_1500"),
    rule("Judgment for Plaintiff (${1})", r"judgment shall enter for the plaintiff to recover \$?([\d,]+)", window="tail_1500"),
    rule("Conditional Judgment Entered", "judgment may enter as follows", window="tail_1500"),
    rule("Question Reserved - No Final Judgment", "reserved for determination by the supreme court"),
]

SUPERIOR_COURT = [
    rule(
        "Judgment for Defendant",
        "judgment (?:may enter|is rendered) for the defendant",
        "issues are found in favor of the defendant",
        window="tail_1500",
    ),
    rule("Judgment for Plaintiff (${1})", r"judgment may be entered against the defendants? for \$?([\d,]+)", window="tail_1500"),
    rule("Judgment for Plaintiff (${1})", r"judgment is therefore entered for the plaintiff to recover \$?([\d,]+)", window="tail_1500"),
    rule("Judgment for Plaintiff (${1})", r"judgment is directed for the plaintiff to recover \$?([\d,]+)", window="tail_1500"),
    rule("Judgment for Plaintiff (${1})", r"judgment for the plaintiff for \$?([\d,]+)", window="tail_1500"),
    rule("Judgment for Plaintiff (${1})", r"judgment is rendered for the plaintiff to recover \$?([\d,]+)", window="tail_1500"),
    rule("Injunction Granted for Plaintiff", "judgment is directed for the plaintiff", window="tail_1500", has="tail_1500:enjoined"),
    rule("Judgment for Plaintiff", "judgment is directed for the plaintiff", window="tail_1500"),
    rule(
        "Judgment for Plaintiff (${amt})",
        "issues are found in favor of the plaintiffs?",
        window="tail_1500",
        amount="bare",
        bare="Judgment for Plaintiff",
    ),
]

EXPLICIT_JUDGMENT = [
    rule(
        "Per Curiam: Judgment {1U}",
        r"per curiam[^.]*\.\s*(?:the )?(?:judgment|decree|order|verdict) is (reversed|affirmed|remanded)",
    ),
    rule("Per Curiam: Arrest of Judgment {1U}", r"per curiam[^.]*\.\s*the arrest of judgment is (reversed|affirmed)"),
    rule("Judgment {1U}", "judgment of the court below is (reversed|affirmed|remanded)"),
    rule("Judgment {1U}", r"(?:judgment|decree) is (reversed|affirmed|remanded)\s", has_any=("judgment", "decree")),
    rule("Judgment {1U}", "(?:judgment|decree) is (affirmed|reversed)", has_any=("judgment", "decree")),
    rule(
        "Judgment AFFIRMED in part, REVERSED in part",
        r"judgment as to the debt[^.]*is affirmed[^.]*as to the damages reversed",
        r"judgment (?:as to [^,]+)?\s*affirmed[^.]*reversed",
    ),
    rule("Judgment REMANDED", "(?:judgment|decree) is remanded", has_any=("judgment", "decree")),
]

END_OF_DOCUMENT = [
    rule("Per Curiam: Judgment SET ASIDE", r"per curiam\. (?:the )?(?:judgment|decree|verdict) is set aside(?: with costs)?", window="tail_2500", costs=True),
    rule("Per Curiam: {1T} {2U}", r"per curiam\.\s*(.*?)(reversed|affirmed|set aside)", window="tail_2500", group_filled=True),
    rule("Per Curiam: {2U}", r"per curiam\.\s*(.*?)(reversed|affirmed|set aside)", window="tail_2500"),
    rule("Per Curiam: Judgment {1U}", r"per curiam\s*[–-]\s*(reversed|affirmed)", window="tail_2500"),
    rule("Decree for {1T}", "the court entered a decree in favou?r of the (complainant|plaintiff|defendant)", window="tail_2500"),
    rule("Decree {1U}", "decree (?:was )?(reversed|affirmed|dismissed)(?: with costs)?", window="tail_2500", costs=True),
    rule("Decree DISMISSED", "the decree is dismissed(?: with costs)?", window="tail_2500", costs=True),
    rule("Bill Dismissed", "the bill is dismissed", window="tail_2500"),
    rule("Injunction {1U}", "the injunction is (dissolved|granted|denied)", window="tail_2500"),
    rule("Verdict: {1U}", "jury (?:found|finds) the defendant (guilty|not guilty)", window="tail_2500"),
    rule("Found {1U}", "defendant is found (guilty|not guilty)", window="tail_2500"),
    rule("Verdict: GUILTY", "verdict of guilty", window="tail_2500"),
    rule("Verdict: NOT GUILTY", "verdict of not guilty", window="tail_2500"),
    rule("Plea {1U}", "plea (?:is )?(?:held )?(good|bad|sufficient|insufficient)", window="tail_2500"),
    rule("Plea SUSTAINED", "plea sustained", window="tail_2500"),
    rule("Plea OVERRULED", "plea overruled", window="tail_2500"),
    rule("Demurrer {1U}", "demurrer (?:is )?(sustained|overruled)", window="tail_2500"),
    rule("Writ of Error {1U}", "writ of error (sustained|denied)", window="tail_2500"),
    rule("Appeal {1U}", "appeal (dismissed|sustained)", window="tail_2500"),
    rule("Sale Void", "sale (?:is )?(?:declared )?void", window="tail_2500"),
    rule("No Title Conveyed", "deed conveyed no title", window="tail_2500"),
    rule("Judgment Void", "judgment void", window="tail_2500"),
    rule("Execution Quashed", "execution quashed", window="tail_2500"),
    rule("Case Dismissed", "case (?:is )?dismissed", window="tail_2500"),
    rule("Indictment Quashed", "indictment quashed", window="tail_2500"),
    rule("Motion {1U}", "motion (?:is )?(granted|overruled|sustained|denied)", window="tail_2500"),
    rule("New Trial {1U}", "new trial (?:is )?(granted|denied)", window="tail_2500"),
    rule("Remanded", "cause remanded", "remanded for further proceedings", window="tail_2500"),
    rule("Judgment AFFIRMED with costs", "judgment affirmed with costs", window="tail_2500"),
    rule("Judgment AFFIRMED", "judgment affirmed", window="tail_2500"),
    rule("Judgment REVERSED with costs", "judgment reversed with costs", window="tail_2500"),
    rule("Judgment REVERSED", "judgment reversed", window="tail_2500"),
    rule("Verdict SET ASIDE", "verdict set aside", window="tail_2500"),
    rule("Proceedings Set Aside", "(?:judgment|proceedings) set aside", window="tail_2500"),
    rule("Recovery Barred", "bar to recovery", "recovery barred", window="tail_2500"),
]

CLOSING_WORDS = [
    rule("Judgment Dismissed", "judgment is dismissed", window="tail_600"),
    rule("Judgment Quashed", "judgment is quashed", window="tail_600"),
    rule("Judgment Sustained", "judgment is sustained", window="tail_600"),
    rule("Judgment Overruled", "judgment is overruled", window="tail_600"),
    rule("Case Dismissed", "is (?:hereby )?dismissed", window="tail_600"),
    rule("Quashed", "is (?:hereby )?quashed", window="tail_600"),
    rule("Sustained", "is (?:hereby )?sustained", window="tail_600"),
    rule("Overruled", "is (?:hereby )?overruled", window="tail_600"),
    rule("Denied", "is (?:hereby )?denied", window="tail_600"),
    rule("Granted", "is (?:hereby )?granted", window="tail_600"),
    rule("Decree for Complainant", "the court entered a decree in favo?u?r of the complainant", window="tail_2500"),
    rule("Recovery Barred", "payments? affecting the assignee no further than to bar his recovery", window="tail_2500"),
    rule("Statute of Limitations Plea Allowed", "may plead the statute of limitations", window="tail_2500"),
    rule("Held: AFFIRMED", r"held[^.]*that (.+?)(?:\.|$)", window="opening", group_has="affirm"),
    rule("Held: REVERSED", r"held[^.]*that (.+?)(?:\.|$)", window="opening", group_has="revers"),
    rule("Held: Error Found", r"held[^.]*that (.+?)(?:\.|$)", window="opening", group_has="error"),
    rule("Judgment AFFIRMED", has="tail_500:affirmed"),
    rule("Judgment REVERSED", has="tail_500:reversed"),
    rule("Remanded", has="tail_500:remanded"),
    rule("Dismissed", has="tail_500:dismissed"),
    rule("Quashed", has="tail_500:quashed"),
    rule("Sustained", has="tail_500:sustained"),
    rule("Overruled", has="tail_500:overruled"),
    rule("Denied", has="tail_500:denied"),
    rule("Granted", has="tail_500:granted"),
    rule("Set Aside", has="tail_500:set aside"),
    rule("Void", has="tail_500:void"),
    rule("Barred", has="tail_500:barred"),
    rule("Judgment REVERSED on Appeal", has=("head_500:appeal from", "tail_500:error")),
]

JUDGMENT_ENTRY = [
    rule("Verdict for Plaintiff", "verdict (?:was )?in favo?u?r of the plaintiff"),
    rule("Judgment for Plaintiff", "judgment may enter for the plaintiff", "judgment enter for the plaintiff"),
    rule("Decree for Plaintiff", "decree in favo?u?r of the plaintiff"),
    rule("Damages Awarded to Plaintiff", "awarded to the plaintiff"),
    rule("Judgment for Defendant", "judgment may enter for the defendant", "judgment enter for the defendant"),
    rule("Verdict for Defendant", "verdict in favo?u?r of the defendant"),
    rule("Complaint Dismissed", "complaint (?:is )?dismissed"),
    rule("Divorce Decree Granted", "decree of divorce (?:is )?(?:granted|entered)", "entitled to a decree of divorce"),
    rule("Trust Construction - Ruling Issued", "questions asked of the court are answered as follows"),
    rule("Ruling Issued as Stated", "judgment may enter in accordance with the above"),
    rule("Judgment Entered (No Costs)", "judgment may enter without costs"),
    rule("Injunction Granted", "injunction will accordingly issue", "injunction (?:is )?(?:hereby )?granted"),
    rule("Damages Awarded", r"recover of the defendants? [\$\d,]+"),
    rule("Held: Plaintiff Entitled to Relief", "the court (?:therefore )?holds? that the plaintiff (?:is )?entitled"),
    rule("Held: Defendant Entitled to Relief", "the court (?:therefore )?holds? that the defendant (?:is )?entitled"),
    rule("Finding for Plaintiff", "the court (?:finds|concludes) that the plaintiff has sustained the burden"),
    rule("Decree for Plaintiff", "plaintiff is found entitled to a decree"),
    rule("Judgment for Defendant - No Desertion", "court cannot find.*?desertion"),
    rule("Verdict for Plaintiffs", "verdict.*?in favor of the plaintiffs"),
    rule("Trust Construction - Ruling Issued", "questions? asked of the court are answered"),
    rule(
        "Judgment for Defendant - No Desertion",
        "cannot find.*?wilful desertion",
        "judgment may accordingly enter for the defendant",
    ),
    rule("Divorce Denied", has=("divorce", "denied", "tail_1000:judgment")),
    rule("Judgment for Defendants", "judgment may be entered in their favor and for them"),
    rule("Judgment for All Defendants", "issues are found in favor of all of the defendants"),
    rule("Judgment for Defendant(s)", "judgment for the defendants?"),
    rule("Judgment for Plaintiff", "judgment may be entered for the plaintiff", "issues are found for the plaintiff"),
    rule("Temporary Injunction Granted", "defendant be and it is hereby temporarily enjoined"),
    rule("Relief from Default and Forfeiture Granted", "relieving it of default and forfeiture"),
    rule("Relief from Forfeiture Granted", "relieve against a forfeiture"),
    rule("Will Construction - Legacy to Issue", "legacy does not become intestate estate"),
    rule("Will Construction - Ruling Issued", "questions submitted in the complaint are answered"),
    rule("Judgment Against Both Defendants", "judgment may be entered against both defendants"),
    rule("Judgment for Plaintiff Against Named Defendant", "judgment for the plaintiff to recover from the defendant sibley"),
    rule(
        "Judgment - Concurrent Negligence Found",
        "was negligent and this negligence was as much the proximate cause",
    ),
]

ADMINISTRATIVE = [
    rule(
        "Award Granted ({amt})",
        r"award in the sum of [\$\d,]+ is hereby granted",
        r"an award .*? is hereby granted",
        amount="after_award",
        bare="Award Granted",
    ),
    rule(
        "Award Granted ({amt})",
        r"recommend an award in the sum of [\$\d,]+",
        amount="after_award",
        bare="Award Recommended - Granted",
    ),
    rule(
        "Award Granted ({amt})",
        r"award of [\$\d,]+ is hereby granted",
        r"we hereby make an award of [\$\d,]+",
        amount="after_award",
        bare="Award Granted",
    ),
    rule("Award Denied", "an award is refused", "award is hereby refused"),
    rule("Award Denied - Claim Dismissed", "we deny an award and dismiss the claim"),
    rule("Award Denied", "award must be refused", "accordingly deny an award"),
    rule("Claim Denied", "claim is disallowed"),
    rule("Award Denied", "no award will be made"),
    rule(
        "Award Granted ({1})",
        r"an award is therefore now made in favo[u]?r of claimant.*?(?:in the said sum of |\$)\s*([\$\d,]+(?:\.\d{2})?)",
    ),
    rule(
        "Award Granted",
        "award is made accordingly",
        "are of the opinion that it should be entered as an approved claim",
    ),
    rule("Award Granted - Claim Just", "the claim is just and should be paid"),
    rule("Award Recommended - Granted", "recommends the payment to the claimant"),
    rule("Award Granted", "an award is therefore now made"),
    rule("Award Denied", "refuse to make an award"),
    rule("Claim Denied", "claim is not entitled to recover"),
    rule("Award Granted (${1})", r"an award in the sum of \$?([\d,]+(?:\.\d{2})?) is hereby made accordingly"),
    rule("Award Granted (${1})", r"an award is therefore made in favo[u]?r of claimant.*?in the sum of " + _AMT),
    rule("Award Granted", "an award is hereby made accordingly", "an award is therefore made"),
    rule(
        "Award Granted (Uncontested - ${amt})",
        r"does not contest the claimant'?s? right to an award",
        amount="tail_1000",
        bare="Award Granted (Uncontested Claim)",
    ),
    rule(
        "Award Granted (Approved Claim - ${amt})",
        "should be entered as an approved claim",
        amount="tail_500",
        bare="Award Granted - Approved Claim",
    ),
    rule(
        "Award Recommended - Granted (${amt})",
        "an award is hereby recommended to be paid",
        amount="any",
        bare="Award Recommended - Granted",
    ),
    _granted(r"an award is\s*,?\s*therefore\s*,?\s*made in favo[u]?r of claimant", amount="tail_500"),
    _granted(r"an award in the sum of \$?[\d,]+(?:\.\d{2})? is hereby made", amount="any", bare=None),
    _granted("award is accordingly made in favo[u]?r of claimant", amount="tail_500"),
    _granted(
        "in my judgment an award should be made",
        lacks=("head_2000:dissenting", "head_2000:cannot agree"),
        amount="tail_500",
        bare=None,
    ),
    _granted(r"an award o[f]?\s*,?\s*\$?[\d,]+(?:\.\d{2})? is made to claimant", amount="any", bare=None),
    rule(
        "Settlement Approved - Award Recommended (${amt})",
        "it is therefore recommended that the legislature make an appropriation",
        amount="any",
        bare="Settlement Approved - Award Recommended",
    ),
    _granted(r"we are of opinion to\s*,? and do now\s*,? award the claimant", amount="tail_500"),
    rule(
        "Award Recommended - Granted (${amt})",
        "fair and just award.*?recommend",
        amount="tail_500",
        bare="Award Recommended - Granted",
    ),
    _granted("award is made", amount="any"),
]

DIRECTED_JUDGMENT = [
    rule(
        "Judgment for Defendant",
        "judgment is directed for the defendant",
        "judgment may be entered in favo[u]?r of the defendant",
    ),
    rule(
        "Judgment for Plaintiff on Cross-Complaint (${amt})",
        "judgment in favo[u]?r of the plaintiff on the cross complaint",
        amount="bare_500",
        bare="Judgment for Plaintiff on Cross-Complaint",
    ),
    rule(
        "Judgment for Plaintiff (${amt})",
        r"judgment is entered for the plaintiff to recover \$?([\d,]+) damages",
        r"judgment is rendered that the plaintiff recover from the defendant damages of \$?([\d,]+)",
        r"judgment is to be entered for \$?([\d,]+)",
        amount="bare",
        bare="Judgment for Plaintiff",
    ),
    rule(
        "Judgment for Defendants",
        "judgment may be entered in favo[u]?r of both defendants?",
        r"judgment is\s*,?\s*therefore\s*,? for the defendants?",
    ),
    rule("Interpleader Decree Vacated - No Final Judgment", "order may enter vacating the interlocutory decree of interpleader"),
    rule("Will Construction - Executor Advised", r"executor is\s*,?\s*therefore\s*,? advised"),
    rule("Regulation Declared Invalid - Plaintiff Prevails", "it is therefore declared invalid and illegal"),
    rule("Judgment for Defendants - Accident, No Negligence", "injuries? were the result of accidental means"),
    rule(
        "Judgment for Plaintiff (${amt})",
        r"judgment is entered for the plaintiff to recover damages of \$?([\d,]+)",
        amount="bare",
        bare="Judgment for Plaintiff",
    ),
    rule("Judgment for Defendant", "judgment is rendered in favo[u]?r of the defendants? against the plaintiff"),
    rule(
        "Judgment for Plaintiff Against Both Defendants (${amt})",
        r"judgment will enter in favo[u]?r of the plaintiff against both defendants? to recover \$?([\d,]+)",
        amount="bare",
        bare="Judgment for Plaintiff",
    ),
    rule(
        "Judgment for Plaintiff (${amt})",
        r"judgment is rendered that ([\p{L}\p{N}_\s]+) recover from the defendants? damages of \$?([\d,]+)",
        amount="bare",
        bare="Judgment for Plaintiff",
    ),
    rule("Judgment - Property Free of Claims", "judgment may enter that the property is free of any right"),
    rule("Judgment for Plaintiffs - Boundary Established", "judgment is therefore rendered finding that plaintiffs? own up to the line"),
    rule("Judgment for Defendant", "judgment is given for the defendant"),
    rule(
        "Order - Deposition Enjoined",
        "(?:enjoin|ordered).*?(?:taking|deposition).*?(?:plaintiff|defendant)",
        has="deposition",
        has_any=("enjoin", "restrain"),
    ),
    rule("Judgment - Tax Liens Valid", "liens? in question are therefore valid and existing incumbrances"),
    rule(
        "Judgment for Defendant - Plaintiff Failed to Prove Case",
        "plaintiff has failed to prove (?:by a fair preponderance of the evidence )?the essential allegations",
    ),
    rule("Judgment for Defendant - No Contract Found", "defendant never entered into the contract set forth in the complaint"),
    rule("Judgment for Defendant - Insufficient Proof", "neither of the plaintiffs? has proved the essential allegations"),
]

CLAIM_SPECIALS = [
    rule("Award Granted ($100.00) - Unsafe Bridge", r"award in the sum of one hundred dollars? \(\$100\.00\) is hereby granted"),
    rule("Award Denied - Claim Dismissed", "deny an award and dismiss the claim"),
    rule("Award Denied - Assumption of Risk", "assumes the risk", has="award denied"),
    rule("Award Granted ($150.00) - Property Damage", r"recommend an award in the sum of one hundred fifty dollars? \(\$150\.00\)"),
    rule("Award Denied - Contributory Negligence", "claimant was negligent and by his negligence brought about the accident"),
    rule("Award Denied - Claim Dismissed", "award denied and claim dismissed"),
    rule(
        "Award Granted by Majority ({amt})",
        "award is hereby granted by a majority of the court",
        amount="run",
        bare="Award Granted by Majority",
    ),
    rule("Award Granted ({1})", r"claims?\s+are? allowed in the amount of ([\$\d,]+)"),
    rule("Award Granted ({1})", r"an award will be made to the claimant in the amount of ([\$\d,]+)"),
    rule("Award Granted", "award will accordingly be made in favor of the claimant"),
    rule("Award Granted ({1})", r"claim is allowed in the amount of ([\$\d,]+)"),
    rule("Award Granted ({1})", r"we hereby award the claimant the sum of ([\$\d,]+)"),
    rule("Award Granted ({1})", r"award of ([\$\d,]+) will be made"),
    rule("Award Granted ({1})", r"claim allowed in the amount of ([\$\d,]+)"),
    rule("Claim Disallowed", "claim disallowed"),
    rule("Claim Denied", "we find that the claimant is not entitled to recover"),
    rule("Claim Disallowed - Contributory Negligence", "contributory negligence was the proximate cause"),
    rule("Claim Disallowed - Assumption of Risk", "assumption of a known risk which bars recovery"),
    rule(
        "Claim Disallowed - Contributory Negligence",
        "no recovery will be allowed for injuries where it appears that the person injured "
        "was guilty of contributory negligence",
    ),
    rule("Award Granted (${1})", "award of " + _PAID),
    rule("Award Granted (${1})", "an award is hereby made to the claimant in the amount of " + _PAID),
    rule("Award Granted (${1})", "accordingly award the claimant the sum of " + _PAID),
    rule("Award Granted (${1})", "we are of the opinion to, and do hereby award the claimant the sum of " + _PAID),
    rule("Claim Denied - No Award", "accordingly deny the claim"),
    rule("No Award - Claim Denied", "no award"),
    rule("Award Granted ($1,200.00) - No Offset Allowed", "respondent is not entitled to an offset", has="$1,200.00"),
    rule("Award Granted - Offset Rejected", "respondent is not entitled to an offset"),
    rule("Award Granted ($7,300.00) - Improper Drainage", "common enemy doctrine is not applicable", has="$7,300.00"),
    rule("Award Granted - Drainage Negligence", "common enemy doctrine is not applicable"),
    rule(
        "Award Granted by Stipulation (${amt})",
        "liability and damages are stipulated",
        amount="tail_500",
        bare="Award Granted - Stipulated Liability",
    ),
    rule(
        "Award Granted - Liability Admitted (${amt})",
        "respondent admits? liability",
        amount="tail_500",
        bare="Award Granted - Admitted Liability",
    ),
]

PARTY_JUDGMENT = [
    rule("Judgment for Plaintiff - ${1} Damages", "judgment is directed for her to recover " + _PAID),
    rule(
        "Judgment for Plaintiff - ${1}",
        r"judgment may be entered in favor of the plaintiff against the defendants? [\p{L}\p{N}_\s]+ for " + _PAID,
    ),
    rule("Judgment for Plaintiff", "judgment may be entered in favor of the plaintiff"),
    rule(
        "Judgment for Defendant",
        "judgment may be entered for the defendant",
        "judgment is for the defendant",
        "judgment entered for the defendant",
    ),
    rule(
        "Appeal Dismissed - Judgment for Appellee",
        "judgment may be entered for the appellee dismissing the appeal",
    ),
    rule("Judgment for Plaintiff ($700.00) - Church Premises Liability", "judgment is directed for her to recover", has="$700.00"),
    rule("Judgment for Plaintiff - Premises Liability", "judgment is directed for her to recover"),
    rule("Judgment for Defendant - Replevin Denied", "issues are found for the defendant.*?on the counter-claim"),
    rule(
        "Judgment for Defendant - No Privity",
        "issues are found for the defendant and judgment is rendered for said defendant",
    ),
    rule(
        "Judgment for Defendant - Mortgage Priority Established",
        "issues are found for the defendant.*?whose mortgage is determined to have priority",
    ),
    rule(
        "Judgment for Defendant - Return of Chattels + $$15.00 Damages",
        "judgment may enter for the return of the chattels to defendant",
        has="$15.00",
    ),
    rule("Judgment for Defendant - Return of Chattels", "judgment may enter for the return of the chattels to defendant"),
    rule(
        "Default Opened - Judgment for Defendant",
        "default as to him is ordered opened and judgment may be entered in his favor",
    ),
    rule("Temporary Injunction Granted", "temporary injunction prayed for may issue"),
    rule(
        "Judgment for Defendant - Injunction Granted on Cross-Complaint",
        "judgment may enter on the cross complaint.*?restraining the plaintiffs?",
    ),
    rule(
        "Judgment for Defendant - Outside Scope of Employment",
        "judgment may enter in each case for the defendant",
        has_any=("scope of his employment", "agent"),
    ),
    rule("Judgment for Defendant", "judgment may enter in each case for the defendant"),
    rule("Judgment for Defendant - No Agency Liability", "not acting within the scope of his employment"),
    rule(
        "Judgment on Cross-Complaint - Injunction to Enforce Settlement",
        "judgment may enter on the cross complaint two weeks hence restraining",
    ),
    rule("Judgment for Defendant - Settlement Agreement Bars Action", "answer is a complete defense in avoidance"),
    rule("Default Judgment Entered", "default as to the defendants? (?:is )?entered"),
    rule("Nonsuit Entered", "judgment of nonsuit may enter"),
    rule("Action Withdrawn as to Defendant", "action (?:is )?withdrawn as to the defendant"),
]

CLAIM_AMOUNTS = [
    rule("Award Granted (${1})", r"hereby award the claimants? [\p{L}\p{N}_\s]+ the sum of " + _PAID),
    rule("Award Granted (${1})", r"award is hereby made to the claimants? [\p{L}\p{N}_\s]+ in the amount of " + _PAID),
    rule("Award Granted (${1})", r"award is therefore entered in favor of claimant [\p{L}\p{N}_\s]+ for the said sum of " + _PAID),
    rule("Award Granted (${1})", "we therefore award the claimant the sum of " + _PAID),
    rule("Award Granted (${1})", "an award in that amount is hereby made to the claimant for " + _PAID),
    rule("Award Granted (${1})", r"award to [\p{L}\p{N}_\s]+ " + _PAID),
    rule(
        "Multiple Awards Granted (${amt})",
        r"award to william c\. mclver",
        amount="first_two",
        bare="Multiple Awards Granted",
    ),
    rule(
        "Claims Allowed - Multiple Awards (Total: ${amt})",
        "claims? are? allowed in the amount of",
        amount="total",
        bare="Claims Allowed - Advisory Opinion",
    ),
    rule("Advisory Opinion - Claims Valid", "advisory determination that the claims are valid"),
    rule("Claim Refused - No Jurisdiction", "refuse to entertain the claim"),
    rule(
        "Partial Award Granted (${amt}) - Remaining Disallowed",
        "portion of the petitioner's claim.*?is disallowed",
        amount="tail_500",
        bare="Partial Award Granted - Some Items Disallowed",
    ),
    rule("Claims Allowed - Travel Expenses (Advisory Opinion)", has=("board of architects", "travel expenses")),
    rule("Partial Award Granted - 1970-71 Invoices Only", has=("exxon", "unpaid invoices")),
    rule("Claim Refused - County Jail Not State Agency", has=("county jail", "without jurisdiction")),
    rule(
        "Multiple Awards Granted - Personal Injury (Motorcycle)",
        r"awards?:?\s*(?:helen|lenwood|richard|hans) forney",
    ),
    rule(
        "Judgment for Plaintiff - Unlawful Timber Cutting ($$309)",
        "defendants? acted unlawfully in cutting the timber",
        has="$309",
    ),
    rule(
        "Judgment for Plaintiff - Trespass on Partitioned Land",
        "defendants? acted unlawfully in cutting the timber",
    ),
]

PROCEDURAL = [
    rule("Demurrer {1U}", "demurrer (?:is )?(sustained|overruled)"),
    rule("Plea {1U}", "plea (?:is )?(good|bad|sufficient|insufficient)"),
    rule("Motion {1U}", "motion (?:is )?(granted|denied|overruled|sustained)"),
    rule("Instruction {1U}", "instruction (?:was )?(refused|given)"),
    rule("Injunction {1U}", "injunction (?:is )?(granted|denied|dissolved)"),
    rule("Writ of Error {1U}", "writ of error (sustained|denied)"),
    rule("Bill Dismissed", "bill dismissed"),
    rule(
        "Legal Ruling (No Final Judgment)",
        "held.*that",
        "the court held",
        "the following points were determined",
        window="head_2000",
        lacks_pattern=("tail_1500", "(judgment|decree|verdict).*(reversed|affirmed|entered)"),
    ),
]

# Blocks in order, each with the words of which every one of its rules needs one.
VERDICT_BLOCKS = [
    ("claims_quick", ("award", "ratified"), CLAIMS_QUICK),
    ("claims", ("award", "damage", "appropriation"), CLAIMS),
    ("end_templates", ("award", "judgment", "damages", "reserved"), END_TEMPLATES),
    ("superior_court", ("judgment", "issues"), SUPERIOR_COURT),
    ("explicit_judgment", ("judgment", "decree", "curiam"), EXPLICIT_JUDGMENT),
    ("end_of_document", (), END_OF_DOCUMENT),
    ("closing_words", (), CLOSING_WORDS),
    (
        "judgment_entry",
        (
            "plaintiff", "defendant", "judgment", "complaint", "divorce", "court", "injunction",
            "desertion", "forfeiture", "legacy", "negligence",
        ),
        JUDGMENT_ENTRY,
    ),
    ("administrative", ("award", "claim", "appropriation"), ADMINISTRATIVE),
    (
        "directed_judgment",
        (
            "judgment", "interlocutory", "executor", "declared", "accidental", "deposition",
            "incumbrances", "plaintiff", "defendant",
        ),
        DIRECTED_JUDGMENT,
    ),
    (
        "claim_specials",
        ("award", "claim", "negligence", "risk", "respondent", "enemy", "liability"),
        CLAIM_SPECIALS,
    ),
    (
        "party_judgment",
        ("judgment", "issues", "default", "injunction", "scope", "answer", "action"),
        PARTY_JUDGMENT,
    ),
    (
        "claim_amounts",
        ("award", "claim", "architects", "exxon", "jail", "timber"),
        CLAIM_AMOUNTS,
    ),
    (
        "procedural",
        ("demurrer", "plea", "motion", "instruction", "injunction", "writ", "bill", "held", "points"),
        PROCEDURAL,
    ),
]
