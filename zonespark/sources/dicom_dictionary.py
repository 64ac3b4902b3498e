"""VR and keyword of common and of identifying attributes (DICOM PS3.6).

Readers take a `dictionary` parameter, so a caller can pass the full published table instead: a mapping from
eight hexadecimal digits to (VR, keyword). Tags outside the dictionary are read all the same, as UnknownTag.
"""

# Fixed values, in ascending order: tag, VR, keyword. xs is US or SS by Pixel Representation, ox is OB or OW.
_TABLE = """
00020000 UL FileMetaInformationGroupLength
00020001 OB FileMetaInformationVersion
00020002 UI MediaStorageSOPClassUID
00020003 UI MediaStorageSOPInstanceUID
00020010 UI TransferSyntaxUID
00020012 UI ImplementationClassUID
00020013 SH ImplementationVersionName
00080005 CS SpecificCharacterSet
00080008 CS ImageType
00080012 DA InstanceCreationDate
00080013 TM InstanceCreationTime
00080014 UI InstanceCreatorUID
00080016 UI SOPClassUID
00080018 UI SOPInstanceUID
00080020 DA StudyDate
00080021 DA SeriesDate
00080022 DA AcquisitionDate
00080023 DA ContentDate
0008002a DT AcquisitionDateTime
00080030 TM StudyTime
00080031 TM SeriesTime
00080032 TM AcquisitionTime
00080033 TM ContentTime
00080050 SH AccessionNumber
00080060 CS Modality
00080064 CS ConversionType
00080070 LO Manufacturer
00080080 LO InstitutionName
00080081 ST InstitutionAddress
00080090 PN ReferringPhysicianName
00080100 SH CodeValue
00080102 SH CodingSchemeDesignator
00080104 LO CodeMeaning
00081010 SH StationName
00081030 LO StudyDescription
00081032 SQ ProcedureCodeSequence
0008103e LO SeriesDescription
00081040 LO InstitutionalDepartmentName
00081048 PN PhysiciansOfRecord
00081050 PN PerformingPhysicianName
00081060 PN NameOfPhysiciansReadingStudy
00081070 PN OperatorsName
00081080 LO AdmittingDiagnosesDescription
00081090 LO ManufacturerModelName
00081110 SQ ReferencedStudySequence
00081111 SQ ReferencedPerformedProcedureStepSequence
00081115 SQ ReferencedSeriesSequence
00081120 SQ ReferencedPatientSequence
00081140 SQ ReferencedImageSequence
00081150 UI ReferencedSOPClassUID
00081155 UI ReferencedSOPInstanceUID
00081160 IS ReferencedFrameNumber
00082111 ST DerivationDescription
00082112 SQ SourceImageSequence
00082218 SQ AnatomicRegionSequence
00100010 PN PatientName
00100020 LO PatientID
00100021 LO IssuerOfPatientID
00100030 DA PatientBirthDate
00100032 TM PatientBirthTime
00100040 CS PatientSex
00101000 LO OtherPatientIDs
00101001 PN OtherPatientNames
00101010 AS PatientAge
00101020 DS PatientSize
00101030 DS PatientWeight
00101040 LO PatientAddress
00102160 SH EthnicGroup
00102180 SH Occupation
001021b0 LT AdditionalPatientHistory
00104000 LT PatientComments
00120010 LO ClinicalTrialSponsorName
00120020 LO ClinicalTrialProtocolID
00120040 LO ClinicalTrialSubjectID
00180015 CS BodyPartExamined
00181000 LO DeviceSerialNumber
00181020 LO SoftwareVersions
00181030 LO ProtocolName
00181063 DS FrameTime
00185010 LO TransducerData
00186011 SQ SequenceOfUltrasoundRegions
0020000d UI StudyInstanceUID
0020000e UI SeriesInstanceUID
00200010 SH StudyID
00200011 IS SeriesNumber
00200013 IS InstanceNumber
00200020 CS PatientOrientation
00200052 UI FrameOfReferenceUID
00204000 LT ImageComments
00280002 US SamplesPerPixel
00280004 CS PhotometricInterpretation
00280006 US PlanarConfiguration
00280008 IS NumberOfFrames
00280009 AT FrameIncrementPointer
00280010 US Rows
00280011 US Columns
00280030 DS PixelSpacing
00280034 IS PixelAspectRatio
00280100 US BitsAllocated
00280101 US BitsStored
00280102 US HighBit
00280103 US PixelRepresentation
00280106 xs SmallestImagePixelValue
00280107 xs LargestImagePixelValue
00280301 CS BurnedInAnnotation
00280303 CS LongitudinalTemporalInformationModified
00281050 DS WindowCenter
00281051 DS WindowWidth
00281052 DS RescaleIntercept
00281053 DS RescaleSlope
00281054 LO RescaleType
00282110 CS LossyImageCompression
00284000 LT ImagePresentationComments
00321032 PN RequestingPhysician
00321060 LO RequestedProcedureDescription
00380010 LO AdmissionID
00384000 LT VisitComments
00400244 DA PerformedProcedureStepStartDate
00400245 TM PerformedProcedureStepStartTime
00400253 SH PerformedProcedureStepID
00400254 LO PerformedProcedureStepDescription
00400275 SQ RequestAttributesSequence
0040a124 UI UID
0040a730 SQ ContentSequence
50003000 ox CurveData
60000010 US OverlayRows
60000011 US OverlayColumns
60003000 ox OverlayData
60004000 LT OverlayComments
7fe00010 ox PixelData
fffcfffc OB DataSetTrailingPadding
"""

# Fixed values, in ascending order: the other attributes that the confidentiality profile lists as identifying.
_IDENTIFYING = """
00080015 DT InstanceCoercionDateTime
00080024 DA OverlayDate
00080025 DA CurveDate
00080034 TM OverlayTime
00080035 TM CurveTime
00080051 SQ IssuerOfAccessionNumberSequence
00080058 UI FailedSOPInstanceUIDList
00080082 SQ InstitutionCodeSequence
00080092 ST ReferringPhysicianAddress
00080094 SH ReferringPhysicianTelephoneNumbers
00080096 SQ ReferringPhysicianIdentificationSequence
00080201 SH TimezoneOffsetFromUTC
00081041 SQ InstitutionalDepartmentTypeCodeSequence
00081049 SQ PhysiciansOfRecordIdentificationSequence
00081052 SQ PerformingPhysicianIdentificationSequence
00081062 SQ PhysiciansReadingStudyIdentificationSequence
00081072 SQ OperatorIdentificationSequence
00081084 SQ AdmittingDiagnosesCodeSequence
00081195 UI TransactionUID
00083010 UI IrradiationEventUID
00084000 LT IdentifyingComments
00100022 CS TypeOfPatientID
00100050 SQ PatientInsurancePlanCodeSequence
00100101 SQ PatientPrimaryLanguageCodeSequence
00100102 SQ PatientPrimaryLanguageModifierCodeSequence
00101002 SQ OtherPatientIDsSequence
00101005 PN PatientBirthName
00101060 PN PatientMotherBirthName
00101080 LO MilitaryRank
00101081 LO BranchOfService
00101090 LO MedicalRecordLocator
00101100 SQ ReferencedPatientPhotoSequence
00102000 LO MedicalAlerts
00102110 LO Allergies
00102150 LO CountryOfResidence
00102152 LO RegionOfResidence
00102154 SH PatientTelephoneNumbers
001021c0 US PregnancyStatus
001021d0 DA LastMenstrualDate
001021f0 LO PatientReligiousPreference
00102203 CS PatientSexNeutered
00120021 LO ClinicalTrialProtocolName
00120030 LO ClinicalTrialSiteID
00120031 LO ClinicalTrialSiteName
00120042 LO ClinicalTrialSubjectReadingID
00120050 LO ClinicalTrialTimePointID
00120051 ST ClinicalTrialTimePointDescription
00120060 LO ClinicalTrialCoordinatingCenterName
00120071 LO ClinicalTrialSeriesID
00120072 LO ClinicalTrialSeriesDescription
00120081 LO ClinicalTrialProtocolEthicsCommitteeName
00120082 LO ClinicalTrialProtocolEthicsCommitteeApprovalNumber
00181002 UI DeviceUID
00181004 LO PlateID
00181005 LO GeneratorID
00181007 LO CassetteID
00181008 LO GantryID
00181400 LO AcquisitionDeviceProcessingDescription
00184000 LT AcquisitionComments
0018700a SH DetectorID
0018700c DA DateOfLastDetectorCalibration
00189424 LT AcquisitionProtocolDescription
0018a003 ST ContributionDescription
00200200 UI SynchronizationFrameOfReferenceUID
00209161 UI ConcatenationUID
00209164 UI DimensionOrganizationUID
0032000a CS StudyStatusID
00321030 LO ReasonForStudy
00321033 LO RequestingService
00321070 LO RequestedContrastAgent
00324000 LT StudyComments
00380011 LO IssuerOfAdmissionID
0038001e LO ScheduledPatientInstitutionResidence
00380020 DA AdmittingDate
00380021 TM AdmittingTime
00380040 LO DischargeDiagnosisDescription
00380050 LO SpecialNeeds
00380060 LO ServiceEpisodeID
00380061 LO IssuerOfServiceEpisodeID
00380062 LO ServiceEpisodeDescription
00380300 LO CurrentPatientLocation
00380400 LO PatientInstitutionResidence
00380500 LO PatientState
00400001 AE ScheduledStationAETitle
00400002 DA ScheduledProcedureStepStartDate
00400003 TM ScheduledProcedureStepStartTime
00400004 DA ScheduledProcedureStepEndDate
00400005 TM ScheduledProcedureStepEndTime
00400006 PN ScheduledPerformingPhysicianName
00400007 LO ScheduledProcedureStepDescription
0040000b SQ ScheduledPerformingPhysicianIdentificationSequence
00400010 SH ScheduledStationName
00400011 SH ScheduledProcedureStepLocation
00400012 LO PreMedication
00400241 AE PerformedStationAETitle
00400242 SH PerformedStationName
00400243 SH PerformedLocation
00400250 DA PerformedProcedureStepEndDate
00400251 TM PerformedProcedureStepEndTime
00400280 ST CommentsOnThePerformedProcedureStep
00401001 SH RequestedProcedureID
00401010 PN NamesOfIntendedRecipientsOfResults
00401400 LT RequestedProcedureComments
00402001 LO ReasonForTheImagingServiceRequest
00402008 PN OrderEnteredBy
00402009 SH OrderEntererLocation
00402010 SH OrderCallbackPhoneNumber
00402016 LO PlacerOrderNumberImagingServiceRequest
00402017 LO FillerOrderNumberImagingServiceRequest
00402400 LT ImagingServiceRequestComments
00403001 LO ConfidentialityConstraintOnPatientDataDescription
0040a027 LO VerifyingOrganization
0040a075 PN VerifyingObserverName
0040a078 SQ AuthorObserverSequence
0040a07a SQ ParticipantSequence
0040a07c SQ CustodialOrganizationSequence
0040a123 PN PersonName
00700001 SQ GraphicAnnotationSequence
00700084 PN ContentCreatorName
00700086 SQ ContentCreatorIdentificationCodeSequence
00880140 UI StorageMediaFileSetUID
00880200 SQ IconImageSequence
04000100 UI DigitalSignatureUID
04000402 SQ ReferencedDigitalSignatureSequence
04000403 SQ ReferencedSOPInstanceMACSequence
30060024 UI ReferencedFrameOfReferenceUID
300600c2 UI RelatedFrameOfReferenceUID
40080042 LO ResultsIDIssuer
40080102 PN InterpretationRecorder
4008010a PN InterpretationTranscriber
4008010b ST InterpretationText
4008010c PN InterpretationAuthor
40080111 SQ InterpretationApproverSequence
40080114 PN PhysicianApprovingInterpretation
40080115 LT InterpretationDiagnosisDescription
40080118 SQ ResultsDistributionListSequence
40080119 PN DistributionName
4008011a LO DistributionAddress
40080202 LO InterpretationIDIssuer
40080300 ST Impressions
40084000 ST ResultsComments
"""


def read_table(text: str) -> dict[str, tuple[str, str]]:
    """A dictionary from lines of tag, VR and keyword, such as a caller may keep the whole published table in."""
    return {tag: (vr, keyword) for tag, vr, keyword in (line.split() for line in text.split("\n") if line)}


DICTIONARY = read_table(_TABLE) | read_table(_IDENTIFYING)
